"""Queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm import bpe, exact_dedup, hard_negatives, language, lexical_search, line_dedup, media, mixing, near_dedup, nearest, secrets, substring_dedup, toxicity
from talkframe.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_random")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and SHA-256 of what is left of each text; a null text counts as empty, which has one line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.line_dedup(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    return kept.select("doc_id", F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are every hundredth vector; the label of every seventh one is moved on first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are every hundredth vector."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_substring_dedup, op3_secrets, op4_mix, op5_exact_dedup,
        op6_toxicity, op7_line_dedup, op8_transport_streams, op9_near_dedup, op10_bpe,
        op11_lexical_search, op12_hard_negatives, op13_nearest,
    )
}

ORACLE_SQL = {
    "op12_hard_negatives": r"""
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
              FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
              CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
              FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op11_lexical_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        n AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
        g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
        p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM n) GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        a AS (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM a),
        s AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * docs) // total))))) AS BIGINT) AS score
              FROM q JOIN f USING (term) JOIN p USING (term), g GROUP BY ALL),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10""",
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM d WHERE len(w) >= 13),
        h AS (SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + 12), ' ')) AS h FROM i),
        f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, pos + j AS p FROM h JOIN f USING (h), (SELECT unnest(range(0, 13)) AS j) WHERE first < doc_id),
        g AS (SELECT doc_id, list(p) AS p FROM gone GROUP BY doc_id),
        k AS (SELECT d.doc_id, w, coalesce(p, []) AS p FROM d LEFT JOIN g USING (doc_id)),
        u AS (SELECT doc_id, w, len(p) AS n_removed, CASE WHEN len(p) = 0 THEN w ELSE list_filter(w, lambda x, n: NOT list_contains(p, n)) END AS kept FROM k)
        SELECT doc_id, len(w) AS n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM u""",
    "op7_line_dedup": r"""
        WITH x AS (SELECT doc_id, coalesce(text, '') AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
        l AS (SELECT doc_id, line, string_split(text, chr(10))[line + 1] AS raw FROM x),
        s AS (SELECT doc_id, line, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM l),
        n AS (SELECT doc_id, line, s, lead(line) OVER w AS next, lead(s) OVER w AS next_s FROM s WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
        k AS (SELECT doc_id, line, [line, next] AS covered, 'run' || s || chr(10) || next_s AS key FROM n WHERE next IS NOT NULL
              UNION ALL SELECT doc_id, line, [line], 'one' || s FROM n WHERE len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) >= 50),
        f AS (SELECT doc_id, covered, row_number() OVER (PARTITION BY md5(key) ORDER BY doc_id, line) AS nth FROM k),
        g AS (SELECT DISTINCT doc_id, unnest(covered) AS line FROM f WHERE nth > 1),
        r AS (SELECT l.doc_id, l.line, l.raw FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line WHERE g.line IS NULL),
        t AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line) AS text FROM r GROUP BY doc_id)
        SELECT d.doc_id, len(string_split(coalesce(t.text, ''), chr(10))) AS n_lines, sha256(coalesce(t.text, '')) AS kept_sha256 FROM documents d LEFT JOIN t USING (doc_id)""",
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
}
