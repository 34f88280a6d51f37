"""Hard negatives by one-dimensional distance keys.

Scores are inner products of whole-numbered vectors. A vector x gets one component more, the root of M - |x|^2, where
M is the largest |x|^2, and a query q a zero: then |q - x|^2 = |q|^2 + M - 2 q.x, and the highest score is the nearest.

1. Index. Each vector belongs to its nearest pivot, and its key is (pivot, distance to it). The table is dealt out and
   sorted by key, so that a shard is a range of keys; a pivot of many vectors, or one vector that repeats, is many shards.
2. Scan. In a shard a query looks at keys within r of its own distance to their pivot, and r grows: by the triangle
   inequality all others are farther than r. Once the k-th score found is above what r leaves possible, or above what is
   known to be reached elsewhere, the shard is done; a shard whose keys are all too far isn't looked into.
3. Bounds. A query first searches the shard that it lies in itself, which gives a score that its k-th one reaches. With
   that it meets all shards, in blocks of queries, and the best of the shards are merged.

Positives are searched first (the same label), then negatives: the best of another label within a band of scores for
each positive. Bands are searched together, in one scan a query and shard. Pivots are fitted on a bounded sample; they
decide how much is looked at, never the result.

Defined results: rows without an id, a label or a whole finite vector take no part; of rows that repeat an id the
smallest label and vector counts; vectors of another length than most take no part; an anchor without positives, and a
positive without negatives in its band, have no rows; equal scores go by ascending id; negative positive scores have
empty bands; scores are exact below 2^53; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.common import written
from talkframe.llm.vectors import against, lists, matrix, usable

_LONG = np.iinfo(np.int64)
_FOUND = "query long, band int, vec_id long, score long"


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))


def fitted_pivots(sample: np.ndarray, n: int, turns: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of the sample by a few turns of k-means; fewer where vectors repeat."""
    sample = np.unique(sample, axis=0)
    centres = sample[np.sort(np.random.default_rng(seed).permutation(len(sample))[:n])]
    for _ in range(turns):
        near = distances(sample, centres).argmin(axis=1)
        centres = np.array([sample[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
    return centres


class Shard:
    """A range of keys: vectors sorted by pivot and distance."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, pivot: np.ndarray, key: np.ndarray, pivots: np.ndarray, most: float):
        order = np.lexsort((ids, key, pivot))
        self.ids, self.labels, self.x, self.key, self.most = ids[order], labels[order], x[order], key[order], most
        self.of, first = np.unique(pivot[order], return_index=True)
        self.runs = list(zip(first, np.append(first[1:], len(order)), strict=True))
        self.pivots = pivots

    def search(self, queries: np.ndarray, query_ids: np.ndarray, query_labels: np.ndarray, same: bool, low: list, high: list, k: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(query, band, ids, scores) of the best k in each band [low, high] of a query."""
        norms = (queries * queries).sum(axis=1)
        to_pivots = distances(np.column_stack([queries, np.zeros(len(queries))]), self.pivots[self.of])
        gaps = np.maximum(0.0, np.maximum(np.array([self.key[a] for a, _ in self.runs]) - to_pivots, to_pivots - np.array([self.key[b - 1] for _, b in self.runs])))
        # no score of the shard can be above this
        best = self._reach(norms, gaps.min(axis=1))
        out = []
        for i in np.flatnonzero(best >= np.array([min(x) for x in low])):
            out += [(int(i), band, ids, scores) for band, ids, scores in self._scan(queries[i], query_ids[i], query_labels[i], norms[i], to_pivots[i], gaps[i], same, low[i], high[i], k) if len(ids)]
        return out

    def _reach(self, norm: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """The highest score at this distance and beyond, with room for rounding."""
        scale = norm + self.most
        return (scale - distance * distance) / 2 + 1e-9 * scale + 1e-6

    def _scan(self, q, own, label, norm, to_pivots, gaps, same, low, high, k):
        spans = [[int(np.searchsorted(self.key[a:b], d)) + a] * 2 for (a, b), d in zip(self.runs, to_pivots, strict=True)]
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        start = gaps.min()
        step = max(1e-9, max(abs(self.key[a] - d) + abs(self.key[b - 1] - d) for (a, b), d in zip(self.runs, to_pivots, strict=True)) / 32)
        floors, r = list(low), start
        while True:
            r += step
            for span, (a, b), d in zip(spans, self.runs, to_pivots, strict=True):
                left, right = int(np.searchsorted(self.key[a:b], d - r)) + a, int(np.searchsorted(self.key[a:b], d + r, "right")) + a
                left, right = min(left, span[0]), max(right, span[1])
                for x, y in ((left, span[0]), (span[1], right)):
                    if x < y:
                        s = self.x[x:y] @ q
                        fit = ((self.labels[x:y] == label) == same) & (s >= min(floors)) & (self.ids[x:y] != own)
                        ids, scores = np.append(ids, self.ids[x:y][fit]), np.append(scores, s[fit])
                span[:] = left, right
            for band, (lo, hi) in enumerate(zip(low, high, strict=True)):
                inside = scores[(scores >= lo) & (scores <= hi)]
                if len(inside) >= k:
                    floors[band] = max(floors[band], float(np.partition(inside, -k)[-k]))
            if self._reach(norm, r) < min(floors) or all(span == [a, b] for span, (a, b) in zip(spans, self.runs, strict=True)):
                break
            step *= 2
        for band, (lo, hi) in enumerate(zip(low, high, strict=True)):
            at = np.flatnonzero((scores >= lo) & (scores <= hi))
            at = at[np.lexsort((ids[at], -scores[at]))][:k]
            yield band, ids[at], scores[at]


def whole_numbers(points: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, vector (floor of scale times the component) and norm, its squared length."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.floor(scale * matrix(b.column("vector")))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), lists(x), pa.array((x * x).sum(axis=1))], names=["vec_id", "label", "vector", "norm"])

    return points.select("vec_id", "label", "vector").mapInArrow(run, "vec_id long, label long, vector array<double>, norm double")


def indexed(points: DataFrame, pivots: np.ndarray, most: float, shards: int) -> DataFrame:
    """points with pivot and key, dealt out to shards by them: a table in the shared folder."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                d = distances(augmented(matrix(b.column("vector")), most), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["vec_id", "label", "vector", "pivot", "key"])

    keyed = points.select("vec_id", "label", "vector").mapInArrow(run, "vec_id long, label long, vector array<double>, pivot int, key double")
    dealt = keyed.repartitionByRange(shards, "pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id")
    return written(dealt.withColumn("shard", F.spark_partition_id()))


def searched(index: DataFrame, queries: DataFrame, pivots: np.ndarray, most: float, same: bool, k: int) -> DataFrame:
    """query, band, vec_id and score: the best k of each shard and block that the queries share with the index."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and asked.num_rows:
            of = lambda t, c: t.column(c).to_numpy()
            shard = Shard(of(rows, "vec_id"), of(rows, "label"), matrix(rows.column("vector")), of(rows, "pivot"), of(rows, "key"), pivots, most)
            ids = of(asked, "vec_id")
            found = [(ids[i], band, a, s) for i, band, a, s in shard.search(matrix(asked.column("vector")), ids, of(asked, "label"), same, asked.column("low").to_pylist(), asked.column("high").to_pylist(), k)]
        sizes = [len(a) for *_, a, _ in found]
        flat = lambda j, kind: np.concatenate([f[j] for f in found]).clip(_LONG.min, _LONG.max).astype(kind) if found else np.zeros(0, kind)
        return pa.table({
            "query": pa.array(np.repeat([f[0] for f in found], sizes).astype(np.int64)), "band": pa.array(np.repeat([f[1] for f in found], sizes).astype(np.int32)),
            "vec_id": pa.array(flat(2, np.int64)), "score": pa.array(flat(3, np.int64)),
        })

    asked = queries.select("shard", "block", "vec_id", "label", "vector", "low", "high")
    rows = index.select("shard", "block", "vec_id", "label", "vector", "pivot", "key")
    return rows.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query", "band").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _bounded(index: DataFrame, queries: DataFrame, pivots: np.ndarray, most: float, same: bool, k: int, shards: int, rows: int) -> DataFrame:
    """query, band, vec_id, score and rank of the best k; queries have the shard that they lie in."""
    home = searched(index.withColumn("block", F.lit(0)), queries.withColumn("block", F.lit(0)), pivots, most, same, k)
    # what the k-th score reaches at least
    reached = _best(home, k).where(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("band", F.col("score").cast("double")))).alias("reached"))
    raised = queries.join(reached, F.col("vec_id") == F.col("query"), "left").withColumn(
        "low", F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("reached", i), F.lit(float("-inf")))))
    )
    rows_of, asked = against(index, written(raised.drop("query", "reached", "shard")), shards, rows)
    return _best(searched(rows_of, asked, pivots, most, same, k), k)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
    positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: int = 256,
    rows_per_shard: int = 8192, queries_per_block: int = 8192, sample: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    anchor: a condition on vec_id; label: the rows' labels (the column label by default); band: the least and the
    highest hundredths of the positive's score; sample: of vectors, that the pivots are fitted on.
    """
    points = written(whole_numbers(usable(rows, id_col, vector_col, F.col("label") if label is None else label).where("label IS NOT NULL"), scale))
    n, most = points.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    drawn = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()["vector"]
    pivots = fitted_pivots(augmented(np.stack(drawn.to_numpy()), most), max(1, min(64, int(n**0.5) // 4))) if n else np.zeros((1, 1))
    shards = max(1, -(-n // rows_per_shard))
    index = indexed(points, pivots, most, shards)
    shards = index.agg(F.coalesce(F.max("shard") + 1, F.lit(1))).first()[0]
    asked = index.where(anchor).select("shard", "vec_id", "label", "vector")
    whole = asked.withColumns({"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))})
    found = written(_bounded(index, whole, pivots, most, True, positives, shards, queries_per_block).select("query", "vec_id", "score", "rank"))
    # bands that no whole number lies in are left out
    ends = F.expr(f"if(score >= 0, array(cast((score * {band[0]} + 99) div 100 AS double), cast((score * {band[1]}) div 100 AS double)), NULL)")
    bands = found.withColumn("ends", ends).where("ends IS NOT NULL AND ends[0] <= ends[1]")
    per = bands.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "ends"))).alias("all"))
    per = per.select("query", F.col("all.vec_id").alias("positive"), F.col("all.score").alias("positive_score"), F.transform("all.ends", lambda x: x[0]).alias("low"), F.transform("all.ends", lambda x: x[1]).alias("high"))
    both = written(asked.join(per, F.col("vec_id") == F.col("query")).drop("query"))
    mined = _bounded(index, both, pivots, most, False, negatives, shards, queries_per_block)
    named = mined.join(both.select(F.col("vec_id").alias("anchor_id"), "positive", "positive_score"), F.col("query") == F.col("anchor_id"))
    return named.select(
        "anchor_id", F.get("positive", F.col("band")).alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.get("positive_score", F.col("band")).alias("positive_score"), F.col("score").alias("negative_score"),
    )
