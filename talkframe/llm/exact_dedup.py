"""Exact dedup by a heavy-hitter split.

Every text becomes the SHA-256 of its white-space-normalised form. Misra-Gries summaries, one a task and
merged by summing, name the digests that may be frequent; an exact count verifies them. The verified winners
(at most `counters` rows, so their broadcast is bounded) settle their copies on the map side, without moving
a row. The remaining digests are counted with a map-side combine and joined with their counts, so that a digest
below the counters, which may still have many rows, is spread over tasks where the join is skewed.

Defined results: a null text counts as empty; a null id never beats another one, and a group with null ids
only keeps those rows; rows that repeat an id with the same text are one document and share its `kept`;
a text of any length is read whole;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import SPACE_CLASS, written


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ").cast("binary"), 256)


def misra_gries(batches: Iterable[Counter], counters: int) -> Counter:
    """Summary of a stream of counted batches: each value's count less at most total / (counters + 1)."""
    summary: Counter = Counter()
    for counted in batches:
        summary.update(counted)
        if len(summary) > counters:
            cut = sorted(summary.values(), reverse=True)[counters]
            summary = Counter({k: v - cut for k, v in summary.items() if v > cut})
    return summary


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted():
            for b in batches:
                yield Counter({x["values"]: x["counts"] for x in b.column(0).value_counts().to_pylist()})

        found = misra_gries(counted(), counters)
        yield pa.RecordBatch.from_pydict(
            {"text_sha256": pa.array(list(found), pa.string()), "at_least": pa.array(list(found.values()), pa.int64())}
        )

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024, min_copies: int = 64) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and text_sha256.

    counters: size of each Misra-Gries summary and most winners to broadcast; min_copies: exact count from
    which a digest is settled on the map side.
    """
    light = written(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256")))
    candidates = (
        light.select("text_sha256").mapInArrow(_summaries(counters), "text_sha256 string, at_least long")
        .groupBy("text_sha256").agg(F.sum("at_least").alias("at_least"))
        .orderBy(F.desc("at_least"), "text_sha256").limit(counters).select("text_sha256")
    )
    winners = written(
        light.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= min_copies)
    )
    heavy = light.join(F.broadcast(winners), "text_sha256")
    rest = light.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # a table of its own, so that the join can split a digest with many rows
    groups = written(rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    rest = rest.join(groups, "text_sha256")
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return heavy.select(*columns).unionAll(rest.select(*columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their columns."""
    stay = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay[id_col]), "left_semi")
