"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets come from water-filling; tokens are dealt in blocks of equal size. Integer block quotas go first to
sources, then to the shards of each source, by highest quotients (size / (2 * seats + 1)). Within a shard the
documents lie one after another in a seeded order, so each block is a range of words; a permutation of
the shard's blocks, drawn by seed, source and shard, says which ones the quota takes, and a document's `taken` is its overlap with them. No block
is taken more often than `max_repeats` times, so no document is either.

Defined results: a null source is a source of its own, last in order; a null or empty text has size 0 and takes
0; ties in the seeded order fall by id, then size; rows that repeat an id count each for themselves; an empty
table gives an empty result; a text of any length is read whole; other columns are ignored, whatever their names. Reruns agree, whatever the partitioning.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.common import word_count, written


#: Sources up to which their targets are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 10_000


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, max_repeats: float) -> list[float]:
    """Shares of total by weight, none above max_repeats times its size; the excess is shared again by weight."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in sorted(open_) if weights[i] * unit > max_repeats * sizes[i]]
        if not above:
            for i in open_:
                targets[i] = weights[i] * unit
            break
        for i in above:
            targets[i] = float(max_repeats * sizes[i])
            left -= targets[i]
            open_.discard(i)
    return targets


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients votes / (2 * seats + 1); ties go to the first; no party above its cap.

    Starts from what a divisor gives for sure, so that the heap deals only the last seats.
    """
    got = [0] * len(votes)
    seats = min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v > 0))
    low, high = 0.0, 2.0 * max(votes, default=0) + 1  # a divisor of at least `high` gives no seat
    for _ in range(60):
        mid = (low + high) / 2
        dealt = sum(min(c, math.floor(v / mid + 0.5)) for v, c in zip(votes, caps, strict=True))
        low, high = (mid, high) if dealt > seats else (low, mid)
    got = [min(c, max(0, math.floor(v / (high * (1 + 1e-9)) + 0.5))) for v, c in zip(votes, caps, strict=True)]
    queue = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, got, caps, strict=True)) if v > 0 and g < c]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def keyed_permutation(n: int, *key: object) -> tuple[int, int]:
    """(multiplier, offset) of a permutation i -> (i * multiplier + offset) mod n, drawn by the key."""
    draw = hashlib.blake2b(repr(key).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    a, b = (int.from_bytes(draw[k : k + 8], "little") % n for k in (0, 8))
    while math.gcd(a, n) != 1:
        a += 1
    return a, b


def repeating_weights(cycle: Sequence[float] = (5, 2, 1)) -> Callable[[list], list[float]]:
    """Weights by the sources' place in code-point order, null last."""
    return lambda sources: [cycle[i % len(cycle)] for i in range(len(sources))]


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Callable[[list], list[float]] | None = None, share: float = 1.5, max_repeats: int = 2,
    block_tokens: int = 8, rows_per_shard: int = 512, seed: int = 20240229,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source.

    Sources are expected to be labels: their totals (one row each) come to the driver, documents never do.
    """
    light = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
    spark = docs.sparkSession
    stats = [tuple(r) for r in light.groupBy("source").agg(F.count("*"), F.sum("size")).collect()]
    stats.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[2] for r in stats]
    targets = water_fill(sizes, (weights or repeating_weights())([r[0] for r in stats]), share * sum(sizes), max_repeats)
    caps = [max_repeats * math.ceil(s / block_tokens) for s in sizes]
    quotas = sainte_lague(targets, round(sum(targets) / block_tokens), caps)
    shards = [max(1, math.ceil(r[1] / max(rows_per_shard, math.isqrt(r[1])))) for r in stats]
    plan = spark.createDataFrame(
        [(r[0], s, float(t), q, n) for r, s, t, q, n in zip(stats, sizes, targets, quotas, shards, strict=True)],
        "source string, source_size long, target double, quota long, shards long",
    )
    key = lambda a, b: a["source"].eqNullSafe(b["source"])
    placed = (
        light.join(F.broadcast(plan) if len(stats) <= MOST_BROADCAST else plan, key(light, plan), "inner").drop(plan["source"])
        .withColumn("mix_key", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("shard", F.pmod(F.xxhash64("mix_key"), F.col("shards")))
    )

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        n = -(-pdf["shard_size"] // block_tokens)
        got = sainte_lague(pdf["shard_size"].tolist(), int(pdf["quota"].iloc[0]), (max_repeats * n).tolist())
        source = pdf["source"].iloc[0]
        drawn = [keyed_permutation(max(int(k), 1), seed, source if isinstance(source, str) else None, int(s)) for k, s in zip(n, pdf["shard"], strict=True)]
        return pd.DataFrame({
            "source": pdf["source"], "shard": pdf["shard"], "blocks": n, "passes": [g // max(k, 1) for g, k in zip(got, n, strict=True)],
            "extra": [g % max(k, 1) for g, k in zip(got, n, strict=True)], "stride": [a for a, _ in drawn], "first": [b for _, b in drawn],
        })

    dealt = (
        placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
        .groupBy("source").applyInPandas(deal, "source string, shard long, blocks long, passes long, extra long, stride long, first long")
    )
    w = Window.partitionBy("source", "shard").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("end", F.sum("size").over(w)).withColumn("begin", F.col("end") - F.col("size"))
    both = laid.join(dealt.withColumnsRenamed({"source": "d_source", "shard": "d_shard"}), F.col("source").eqNullSafe(F.col("d_source")) & (F.col("shard") == F.col("d_shard")))
    overlap = F.expr(f"""
        aggregate(
            if(size > 0 and extra > 0, sequence(begin div {block_tokens}, (end - 1) div {block_tokens}), cast(array() as array<bigint>)), 0L,
            (taken, i) -> taken + if(pmod(i * stride + first, blocks) < extra,
                least(end, (i + 1) * {block_tokens}) - greatest(begin, i * {block_tokens}), 0L))""")
    return both.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + overlap).cast("long").alias("taken"), "source")
