"""The registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockpulse.llm import (
    decontamination,
    digests,
    hard_negatives,
    html_text,
    lexical,
    lines,
    packing,
    signature_join,
    simhash,
    suffix_sort,
    suffix_tree,
    toxicity,
    warc,
)
from dockpulse.llm.common import table, written


def word_tokenizer() -> str:
    """Path of the public word tokenizer; found when a query is called, not on import."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc.doc_id",
        toxicity.held_out(F.col("doc.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.with_kept_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "document.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark"),
    )
    return found.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits an archive of all pages against a replica with damage in known places.

    The replica lacks the pages whose id leaves 1 when divided by 101; of those that leave 3 when
    divided by 97 the first character is another, of those that leave 2 when divided by 103 the
    second half is lost.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    damaged = (
        F.when(F.col("page_id") % 97 == 3, F.concat(F.lit("#"), F.substring(html, 2, 1 << 30)))
        .when(
            F.col("page_id") % 103 == 2,
            F.substring(html, F.lit(1), F.floor(F.char_length(html) / 2).cast("int")),
        )
        .otherwise(html)
    )
    # A record of the replica lies where that of the original does, whatever ids pages have.
    record = warc.record_bytes(F.col("url"), damaged)
    both = warc.archive(
        pages.select(
            "page_id",
            "url",
            "html",
            F.octet_length(record).cast("long").alias("replica_length"),
            F.sha2(record, 256).alias("replica_digest"),
        ),
        carried=("replica_length", "replica_digest"),
    )
    both = written(both, "archives")
    replica = both.where(F.coalesce(F.col("page_id") % 101 != 1, F.lit(True)))
    return warc.audit(
        both.select("file", "offset", "length", "page_id", "digest"),
        replica.select(
            "file",
            "offset",
            F.col("replica_length").alias("length"),
            "page_id",
            F.col("replica_digest").alias("digest"),
        ),
    )


def op6_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_sort.without_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=1)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_tree.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op11_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.similar_sets(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; every seventh label is moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.hard_negatives(rows, lambda vec_id: vec_id % 100 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_digests": op2_digests,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_suffix_sort": op6_suffix_sort,
    "op7_packing": op7_packing,
    "op8_html_text": op8_html_text,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_simhash": op10_simhash,
    "op11_signature_trees": op11_signature_trees,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical_search": op13_lexical_search,
}

SQL = {
    "op3_line_dedup": r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (
    SELECT doc_id, pos, lines[pos] AS line,
           translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM docs, unnest(range(1, len(lines) + 1)) AS t(pos)
),
repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed
    WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
judged AS (
    SELECT k.doc_id, pos, line, keeper IS NOT NULL AND k.doc_id <> keeper AS dropped
    FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
           AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op4_decontamination": r"""
WITH folded AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
windows AS (
    SELECT id AS item_id, least(len(words), 10) AS size,
           array_to_string(words[p:p + least(len(words), 10) - 1], ' ') AS run
    FROM folded, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS t(p)
    WHERE kind = 'b' AND len(words) > 0
),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT id AS doc_id, p, s.size, array_to_string(words[p:p + s.size - 1], ' ') AS run
    FROM folded, sizes s, unnest(range(1, len(words) - s.size + 2)) AS t(p)
    WHERE kind = 'd'
),
found AS (SELECT doc_id, p, item_id, f.size FROM places f JOIN windows w USING (size, run)),
hits AS (
    SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + size)) AS t(q)
    GROUP BY doc_id
),
named AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
    FROM found GROUP BY doc_id
)
SELECT f.id AS doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN hits h ON f.id = h.doc_id LEFT JOIN named n ON f.id = n.doc_id
WHERE kind = 'd'
""",
    "op5_warc_fixity": r"""
WITH records AS (
    SELECT page_id, page_id // 1024 AS file, chr(13) || chr(10) AS crlf, coalesce(html, '') AS html, coalesce(url, '') AS url,
           strlen(coalesce(url, '')) + strlen(coalesce(html, ''))
           + strlen(strlen(coalesce(html, ''))::VARCHAR) + 99 AS length
    FROM pages
),
placed AS (
    SELECT *, coalesce(sum(length) OVER (
        PARTITION BY file
        ORDER BY page_id, url, sha256('WARC/1.1' || crlf || 'WARC-Type: resource' || crlf
            || 'WARC-Target-URI: ' || url || crlf || 'Content-Type: text/html' || crlf
            || 'Content-Length: ' || strlen(html) || crlf || crlf || html || crlf || crlf)
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
    ), 0)::BIGINT AS "offset",
    CASE WHEN page_id % 97 = 3 THEN '#' || substr(html, 2)
         WHEN page_id % 103 = 2 THEN left(html, length(html) // 2) ELSE html END AS damaged
    FROM records
)
SELECT file, "offset", length, page_id,
       CASE WHEN page_id % 101 = 1 THEN 'missing' ELSE 'changed' END AS fault
FROM placed WHERE page_id % 101 = 1 OR damaged <> html
""",
    "op9_suffix_tree": r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
places AS (
    SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS run
    FROM docs, unnest(range(1, len(words) - 11)) AS t(p)
),
earliest AS (SELECT run, min(doc_id) AS first_doc FROM places GROUP BY run),
removed AS (
    SELECT DISTINCT doc_id, q
    FROM places JOIN earliest USING (run), unnest(range(p, p + 13)) AS t(q)
    WHERE first_doc < doc_id
),
judged AS (
    SELECT d.doc_id, pos, words[pos] AS word, r.q IS NOT NULL AS gone
    FROM docs d, unnest(range(1, len(words) + 1)) AS t(pos)
    LEFT JOIN removed r ON r.doc_id = d.doc_id AND r.q = pos
),
kept AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
           string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS text
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op11_signature_trees": r"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words FROM documents
),
shingled AS (
    SELECT DISTINCT r, array_to_string(words[p:p + 4], ' ') AS shingle
    FROM docs, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS t(p) WHERE len(words) > 0
),
contents AS (SELECT r, count(*) AS n, list_sort(list(shingle)) AS shingles FROM shingled GROUP BY r),
classes AS (SELECT shingles, n, min(r) AS c FROM contents GROUP BY shingles, n),
parts AS (SELECT c, n, unnest(shingles) AS shingle FROM classes),
pairs AS (
    SELECT a.c AS x, b.c AS y FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.c < b.c
    GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs UNION ALL SELECT c, c FROM classes),
reached AS (
    SELECT c AS start, c AS node FROM classes
    UNION SELECT start, y FROM reached JOIN links ON node = x
),
roots AS (SELECT start AS c, min(node) AS root FROM reached GROUP BY start),
members AS (
    SELECT r, contents.n, root FROM contents JOIN classes USING (shingles) JOIN roots USING (c)
),
named AS (SELECT root, min(doc_id) AS component_id FROM members JOIN docs USING (r) GROUP BY root)
SELECT doc_id, coalesce(m.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM docs LEFT JOIN members m USING (r) LEFT JOIN named USING (root)
""",
    "op12_hard_negatives": """
WITH sound AS (
    SELECT row_number() OVER () AS ref, vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scores AS (
    SELECT a.ref AS anchor, a.vec_id AS anchor_id, b.ref, b.vec_id, a.label = b.label AS same,
           list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
    FROM sound a JOIN sound b ON a.ref <> b.ref WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor, anchor_id, ref AS pos, vec_id AS positive_id, score AS positive_score
    FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
       row_number() OVER (PARTITION BY anchor, pos ORDER BY score DESC, vec_id) AS rank
FROM positives JOIN (SELECT anchor, vec_id, score FROM scores WHERE NOT same) USING (anchor)
WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""",
    "op13_lexical_search": r"""
WITH texts AS (
    SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark
),
terms AS (
    SELECT kind, r, id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM texts
),
counted AS (SELECT kind, r, id, term, count(*) AS tf FROM terms GROUP BY kind, r, id, term),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM counted WHERE kind = 'd' GROUP BY r),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counted, totals WHERE kind = 'd' GROUP BY term
),
scored AS (
    SELECT q.r AS query, q.id AS item_id, d.id AS doc_id,
           sum(q.tf * w * ((1000000000 * d.tf)
               // (1000 * d.tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
    FROM counted q JOIN counted d ON q.term = d.term AND q.kind = 'b' AND d.kind = 'd'
    JOIN weights w ON w.term = q.term JOIN sizes s ON s.r = d.r, totals
    GROUP BY q.r, q.id, d.r, d.id
)
SELECT item_id, doc_id, score,
       row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank
FROM scored WHERE score > 0 QUALIFY rank <= 20
""",
}
