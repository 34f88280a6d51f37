"""Vectors that take part in a search, and helpers that searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column | None = None) -> DataFrame:
    """vec_id, label (a long, null without one) and vector (doubles) of the rows that take part.

    Rows without an id and vectors that are null, empty or hold null or non-finite components don't; of rows that
    repeat an id the smallest label and vector counts; a vector of another length than most (the shorter of equally
    many) doesn't.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    known = rows.select(F.col(id_col).cast("long").alias("vec_id"), (F.lit(None) if label is None else label).cast("long").alias("label"), x.alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    known = known.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.coalesce(finite, F.lit(False)))
    one = known.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.*")
    most = one.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return one if most is None else one.where(F.size("vector") == most["dims"])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equally long lists as rows of a matrix."""
    n = len(column)
    flat = np.asarray(pc.list_flatten(column))
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width) if width else np.zeros(n + 1), pa.int32()), pa.array(values.ravel()))


def against(index: DataFrame, queries: DataFrame, shards: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both with columns shard and block: every query meets every shard once, about `rows` queries at a time."""
    blocks = max(1, -(-queries.count() // rows))
    spread = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), spread
