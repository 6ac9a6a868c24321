"""Fixity audit of web archive replicas by Merkle trees over ordered offset ranges.

A replica is a table of records, each with its file, offset and bytes. The leaves of a file's tree
are the hashes of its records; a node of level 1 hashes, in order, the records that start in one
range of ``RANGE`` bytes, and a node of each level above the nodes of ``FANOUT`` neighbouring
ranges, up to one root per file. Ranges are fixed by offset, so a record that is lost or damaged
leaves the rest of both trees aligned.

``audit`` compares the roots of two replicas and goes down only where they differ: each level
joins the children of the mismatching nodes, so its work follows the damage and not the archive.
No group holds more than the records of one range or the children of one node.

Each level is written before the next one is made of it, on the way up and on the way down, so none
is computed twice.

Defined results: null urls and pages are empty; pages without an id go to ``LOOSE_FILES`` files with
numbers below zero, by a hash of their content; equal ids follow one another by url and page; an empty
replica lacks every record of the other one; two empty replicas give no rows. Other columns of the
pages are read only if they are to be carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockpulse.llm.common import written

#: Pages of an archive file, bytes of the ranges above the records, children of a node above.
FILE_PAGES = 1024
LOOSE_FILES = 4096
RANGE = 1 << 16
FANOUT = 16


def record_bytes(url: Column, html: Column) -> Column:
    """A page as a WARC resource record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def archive(
    pages: DataFrame, file_pages: int = FILE_PAGES, carried: Sequence[str] = ()
) -> DataFrame:
    """(file, offset, length, page_id, digest, *carried): the records of pages written to files by
    id; ``carried`` columns of the pages stay with their records."""
    place = F.col("page_id").cast("long")
    record = record_bytes(F.col("url"), F.col("html"))
    loose = F.lit(-1) - F.pmod(F.xxhash64("url", "html"), F.lit(LOOSE_FILES))
    rows = pages.select(
        F.coalesce(F.floor(place / file_pages), loose).cast("long").alias("file"),
        place.alias("place"),
        place.alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("digest"),
        *carried,
    )
    before = (
        Window.partitionBy("file")
        .orderBy("place", "url", "digest")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))
    return rows.select("file", offset.alias("offset"), "length", "page_id", "digest", *carried)


def tree(
    records: DataFrame, top: int, range_bytes: int = RANGE, fanout: int = FANOUT
) -> list[DataFrame]:
    """(file, node, length, page_id, digest) of each level from the records, 0, to ``top``.

    A record's node is its offset; ``length`` and ``page_id`` are null above the records.
    """
    leaves = records.select(
        "file", F.col("offset").alias("node"), "length", "page_id", "digest"
    )
    nodes, below, width = [leaves], leaves, range_bytes
    for _ in range(top):
        parts = F.sort_array(F.collect_list(F.struct("node", "digest")))
        lines = F.transform(parts, lambda x: F.concat_ws(" ", x.node.cast("string"), x.digest))
        below = (
            below.groupBy("file", F.floor(F.col("node") / width).cast("long").alias("up"))
            .agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
            .select(
                "file",
                F.col("up").alias("node"),
                F.lit(None).cast("long").alias("length"),
                F.lit(None).cast("long").alias("page_id"),
                "digest",
            )
        )
        below = written(below, "merkle-level")
        nodes.append(below)
        width = fanout
    return nodes


def levels_for(last: int, range_bytes: int = RANGE, fanout: int = FANOUT) -> int:
    """The level at which one node covers every offset up to ``last``."""
    level, reach = 1, range_bytes
    while reach <= last:
        level, reach = level + 1, reach * fanout
    return level


def audit(
    original: DataFrame, replica: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT
) -> DataFrame:
    """(file, offset, length, page_id, fault) of records that the replica changed, lacks or adds.

    Both have the columns of ``archive``. ``length`` and ``page_id`` are those of the original,
    for an added record those of the replica.
    """
    sides = [written(side, "archive") for side in (original, replica)]
    last = max((s.agg(F.max("offset")).first()[0] or 0) for s in sides)
    top = levels_for(last, range_bytes, fanout)
    trees = [tree(s, top, range_bytes, fanout) for s in sides]

    def differing(level: int, parents: DataFrame | None) -> DataFrame:
        width = range_bytes if level == 0 else fanout
        found = []
        for side in trees:
            rows = side[level]
            if parents is not None:
                up = F.floor(F.col("node") / width).cast("long")
                rows = rows.withColumn("up", up).join(parents, ["file", "up"], "left_semi").drop("up")
            found.append(rows)
        a, b = (rows.alias(name) for rows, name in zip(found, "ab"))
        return a.join(b, ["file", "node"], "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))

    mismatches = None
    for level in range(top, 0, -1):
        wrong = differing(level, mismatches).select("file", F.col("node").alias("up"))
        mismatches = written(wrong, "mismatches")
    records = differing(0, mismatches)
    fault = (
        F.when(F.col("b.digest").isNull(), "missing")
        .when(F.col("a.digest").isNull(), "added")
        .otherwise("changed")
    )
    lost = F.col("a.digest").isNull()
    return records.select(
        "file",
        F.col("node").alias("offset"),
        F.when(lost, F.col("b.length")).otherwise(F.col("a.length")).alias("length"),
        F.when(lost, F.col("b.page_id")).otherwise(F.col("a.page_id")).alias("page_id"),
        fault.alias("fault"),
    )
