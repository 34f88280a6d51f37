"""Connected components by label propagation with pointer jumping; only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import released, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id that it reaches.

    Each round takes the smallest label among neighbours, then the label of that label, until nothing changes.
    A group's rows are combined before they are shuffled, and joins on a hot id can be split.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "id")
        least = labels.select("id", F.col("component").alias("was")).join(near, "id").select("id", "was", F.least("was", "near").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = least.join(up, "component", "left").select("id", F.least("component", F.coalesce("above", "component")).alias("component"), "was")
        labels = written(new.select("id", "component", (F.col("component") != F.col("was")).alias("moved")))
        released(edges.sparkSession)
        if labels.where("moved").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")


def roots(parents: DataFrame) -> DataFrame:
    """(id, component) of parents (id, parent), one a row and smaller than the id: where its line of parents ends. Ids that are only parents stand for themselves."""
    labels = written(parents.select("id", F.col("parent").alias("component")))
    while True:
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        labels = written(labels.select("id", "component").join(up, "component", "left").select("id", F.coalesce("above", "component").alias("component"), F.col("above").isNotNull().alias("moved")))
        if labels.where("moved").isEmpty():
            top = labels.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
            return written(labels.select("id", "component").unionAll(top))
        labels = labels.select("id", "component")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) after more links (a, b): only the components that the links join are looked at again."""
    ends = links
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("id").alias(c), F.col("component").alias(f"__{c}")), c, "left").withColumn(f"__{c}", F.coalesce(f"__{c}", c))
    # an id that has no label yet is a component by itself
    new = ends.where("a = __a OR b = __b").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("__a").alias("c")), F.struct(F.col("b").alias("id"), F.col("__b").alias("c")))).alias("x")).select("x.*").where("id = c").select("id").distinct()
    joined = written(ends.select(F.col("__a").alias("a"), F.col("__b").alias("b")).where("a <> b").distinct())
    if joined.isEmpty():
        return labels
    over = components(joined).select(F.col("id").alias("component"), F.col("component").alias("__over"))
    known = labels.unionAll(new.withColumn("component", F.col("id")).join(labels.select("id"), "id", "left_anti").select("id", "component"))
    return written(known.join(over, "component", "left").select("id", F.coalesce("__over", "component").alias("component")))
