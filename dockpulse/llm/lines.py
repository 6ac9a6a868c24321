"""Removal of lines that repeat across documents, by sorted line hashes and keep bitmaps.

Lines are reduced to 128-bit hashes of their keys with document and position. Hashes are uniform,
so equal-width ranges of them are a range partitioning that needs no sampling pass. Within a range
the rows are sorted by hash, document (largest first) and position, and one pass over the sorted
rows meets each hash first in the document that keeps it. A frequent line may hold a third of all
rows: its rows are dealt over ``SALTS`` sub-ranges by document, each of which reports only its
first occurrence and number of documents; the reports are combined per hash.

The result is a bitmap per document instead of text: 64 lines to a word, in which a set bit marks
a line to drop, and words without any are left out. Only native DataFrame functions are used.

Defined results: a null or empty text is one empty line; a null doc_id counts as one document
below all others; rows that share a doc_id count as one document and each keeps its lines where
that document is the largest; repeated rows get the same bitmap; an empty table gives no rows.
Columns of the documents may have any names: only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockpulse.llm.common import checkpointed, text_key

MIN_CHARS = 20
MIN_DOCS = 3
#: Sub-ranges of documents that a line's rows are dealt over, and ranges of hashes.
SALTS = 64
RANGES = 4096

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _UPPER.lower())


def drop_bitmaps(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(doc_id, text_key, words): ``words`` maps a block of 64 lines to the bits to drop.

    Documents that keep all lines have no row.
    """
    lines = (
        docs.select("doc_id", text_key("text").alias("text_key"), lines_of(F.col("text")).alias("lines"))
        .select("doc_id", "text_key", F.posexplode("lines").alias("pos", "line"))
        # Trimming and folding keep or shorten a line: a shorter one cannot have a longer key.
        .where(F.char_length("line") >= min_chars)
        .select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            "doc_id",
            "text_key",
            "pos",
        )
        .withColumn("range", F.shiftrightunsigned("h1", 64 - (RANGES.bit_length() - 1)).cast("int"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    )
    sorted_lines = lines.repartition("range", "salt")
    stream = Window.partitionBy("range", "salt", "h1", "h2").orderBy(
        F.col("doc_id").desc_nulls_last(), "pos"
    )
    number = F.row_number().over(stream)
    earlier = F.lag("doc_id").over(stream)
    marked = sorted_lines.select(
        "h1",
        "h2",
        "doc_id",
        "text_key",
        "pos",
        ((number == 1) | ~earlier.eqNullSafe(F.col("doc_id"))).alias("first_of_doc"),
    )
    # Checkpointed, so that the join below shuffles both sides for itself: only then can the
    # adaptive skew join split the rows of a frequent line.
    keys = checkpointed(
        marked.where("first_of_doc")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    dropped = lines.join(keys, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    block = F.shiftright("pos", 6)
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(F.lit(63))
    )
    blocks = dropped.groupBy("doc_id", "text_key", block.alias("block")).agg(
        F.bit_or(bit).alias("bits")
    )
    return blocks.groupBy("doc_id", "text_key").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("block", "bits")))).alias("words")
    )


def with_kept_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``document`` (all columns of the row), ``n_lines``, ``n_dropped`` and the ``kept`` text."""
    bitmaps = drop_bitmaps(docs, min_chars, min_docs).alias("b")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
        F.col("doc_id").alias("row_id"),
        text_key("text").alias("row_key"),
    )
    joined = rows.join(
        bitmaps,
        F.col("row_id").eqNullSafe(F.col("b.doc_id")) & (F.col("row_key") == F.col("b.text_key")),
        "left",
    )
    lines = lines_of(F.col("document.text"))

    def stays(line: Column, pos: Column) -> Column:
        word = F.try_element_at(F.col("words"), F.shiftright(pos, 6))
        bits = F.call_function("shiftrightunsigned", word, pos.bitwiseAND(F.lit(63)))
        return F.coalesce(bits.bitwiseAND(F.lit(1)) == 0, F.lit(True))

    kept = F.array_join(F.filter(lines, stays), "\n")
    count = F.aggregate(
        F.map_values("words"), F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w)
    )
    return joined.select(
        "document",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(count, F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("words").isNull(), F.coalesce("document.text", F.lit(""))).otherwise(kept).alias("kept"),
    )


def without_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with the kept lines as text; documents of which no line is left go.

    ``n_chars``, if there is such a column, follows the new text.
    """
    rows = with_kept_lines(docs, min_chars, min_docs)
    rows = rows.where("n_dropped < n_lines")
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("document.text"))}
    if "n_chars" in docs.columns:
        length = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, length).otherwise(
            F.col("document.n_chars")
        )
    return rows.select(
        *[changed.get(c, F.col("document").getField(c)).alias(c) for c in docs.columns]
    )
