"""A training-data pipeline over `documents`: each stage works on all that its predecessor kept.

toxicity drops the documents that the scorer rejects; line dedup takes later repeated runs of lines out of the
texts; near-dedup keeps one document of each group; mixing repeats each document as often as the mix takes its words,
in whole copies; BPE encodes what is left and decodes it again.

Every stage but the last returns the columns of documents. Stages are written as Parquet in the session's shared
folder and read again, so that a lost executor costs a task and not the stages before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkframe.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from talkframe.llm.common import fold, table, written

#: Probability of label 1 from which a document is rejected.
REJECTED = 0.3
#: Of the draws that round copies in the mix, and documents of a source that are rounded together.
SEED, TOGETHER = 77, 4096
#: Parts of a copy, so that sums of them are exact.
UNIT = 1 << 30


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold; the scorer is fitted on labelled rows of these documents.

    A null or empty text is scored by its neutral features; rows that repeat an id, or have none, are scored each; a
    score of exactly the threshold is rejected; an empty table stays empty; texts are scored whole; all columns stay.
    """
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return toxicity.scored(docs, scorer, column="__score").where(F.col("__score") < REJECTED).drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; no document goes.

    A null text stays null and a text of which nothing is left becomes empty; rows without an id are kept as they are,
    rows that repeat one are one document and don't delete each other; ties fall by id, then position; an empty table
    stays empty; texts are read whole; other columns stay, but that n_chars is counted anew.
    """
    return line_dedup.line_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies.

    Documents with a null or empty text and rows without an id stay; rows that repeat an id are one document and stay
    or go together; an empty table stays empty; texts are read whole; all columns stay.
    """
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document 0, 1 or 2 times: the words taken over its size, a part of a copy rounded up or down.

    Parts are added up along the documents of a source, in the order of their size and TOGETHER at a time, and a
    document gets one copy more wherever the sum passes a whole number: the words of such a group stay within its
    largest document of what the mix takes. Rows that repeat an id are one document, of the first of their sources in
    code-point order, and get the same copies; a document without words gets none; a null source is a source, a null
    id an id; equal sizes go by id; an empty table stays empty; all columns stay. Reruns agree.
    """
    taken = mixing.mix(docs).groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.min("source").alias("source")).where("size > 0")
    taken = written(taken.withColumn("ratio", F.col("taken") / F.col("size")))
    counts = taken.groupBy("source").agg(F.ceil(F.count("*") / TOGETHER).alias("groups")).withColumnRenamed("source", "of")
    grouped = taken.join(counts, F.col("source").eqNullSafe(F.col("of"))).withColumn("group", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.col("groups")))
    along = Window.partitionBy("source", "group").orderBy(F.desc("size"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64(F.lit(SEED), F.lit("start"), "source", "group"), F.lit(UNIT))
    part = F.floor((F.col("ratio") - F.floor("ratio")) * UNIT)
    summed = grouped.withColumn("part", part).withColumn("upto", F.sum("part").over(along) + start)
    more = F.shiftright("upto", UNIT.bit_length() - 1) - F.shiftright(F.col("upto") - F.col("part"), UNIT.bit_length() - 1)
    copies = summed.select(F.col("doc_id").alias("__id"), (F.floor("ratio") + more).cast("int").alias("__copies")).where("__copies > 0")
    both = docs.join(copies, docs["doc_id"].eqNullSafe(copies["__id"]))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document of the mix, a row for each copy.

    A null text counts as empty and has no tokens; rows that repeat an id, or have none, are encoded each; an empty
    table stays empty; texts are read whole; other columns go.
    """
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Scores, draws and tokens have no SQL form; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
