"""Ordered scans over groups of any size: fold ranges of the order, carry what a range ends with, apply.

A window over a whole conversation is one task, however long the conversation. Here a group is cut into segments of its
order; each segment is folded to one row, a window over those rows (the only one over a group as a whole, a row for
thousands) says what each segment begins with, and that goes into the segment as a row of its own in front of it. So
all windows over the rows themselves are over a segment, and nothing is joined back. Null keys are a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Messages of a segment.
SEGMENT = 8192
_OWN = ("__segment", "__carry", "__held")


def by_number(order: str = "seq", size: int = SEGMENT) -> Column:
    return F.expr(f"{order} div {size}")


def cut(rows: DataFrame, segment: Column) -> DataFrame:
    return rows.withColumn("__segment", segment)


def inside(by: list[str], order: list[str], *more: str) -> WindowSpec:
    """Within a segment, what it begins with first."""
    return Window.partitionBy(*by, "__segment", *more).orderBy(F.desc("__carry"), *order)


def along(by: list[str], *more: str) -> WindowSpec:
    """Over the segments of a group, a row each."""
    return Window.partitionBy(*by, *more).orderBy("__segment")


def begun(rows: DataFrame, carries: DataFrame) -> DataFrame:
    """Cut rows with the carried ones, whose __held says what they carry."""
    return rows.withColumn("__carry", F.lit(0)).unionByName(carries.withColumn("__carry", F.lit(1)), allowMissingColumns=True)


def ended(rows: DataFrame) -> DataFrame:
    return rows.where("__carry = 0").drop(*_OWN)


def running_sum(rows: DataFrame, name: str, value: Column, by: list[str], order: list[str], segment: Column) -> DataFrame:
    """The sum of value up to and with each row of its group; a null counts as 0."""
    part = cut(rows, segment).withColumn(name, F.coalesce(value.cast("long"), F.lit(0)))
    totals = part.groupBy(*by, "__segment").agg(F.sum(name).alias("__total"))
    before = F.coalesce(F.sum("__total").over(along(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carries = totals.select(*by, "__segment", before.alias(name))
    return ended(begun(part, carries).withColumn(name, F.sum(name).over(inside(by, order).rowsBetween(Window.unboundedPreceding, 0))))


def numbered(rows: DataFrame, name: str, by: list[str], order: list[str], segment: Column) -> DataFrame:
    """Rows of a group numbered from 1."""
    return running_sum(rows, name, F.lit(1), by, order, segment)


def beside(rows: DataFrame, columns: dict[str, str], by: list[str], order: list[str], segment: Column, after: bool = False) -> DataFrame:
    """New columns with those of the row before, or after, in the group; null where there is none."""
    at, held = F.struct(*order), F.struct(*(F.col(c).alias(new) for new, c in columns.items()))
    part = cut(rows, segment).withColumn("__held", held)
    ends = part.groupBy(*by, "__segment").agg((F.min_by if after else F.max_by)("__held", at).alias("__end"))
    carried = (F.lead if after else F.lag)("__end").over(along(by))
    both = begun(part, ends.select(*by, "__segment", carried.alias("__held")))
    if not after:
        w = inside(by, order)
        both = both.withColumn("__beside", F.lag("__held").over(w))
    else:
        w = Window.partitionBy(*by, "__segment").orderBy("__carry", *order)
        both = both.withColumn("__beside", F.lead("__held").over(w))
    return ended(both.withColumns({new: F.col(f"__beside.{new}") for new in columns}).drop("__beside"))


def around(rows: DataFrame, column: str, by: list[str], order: list[str], segment: Column) -> DataFrame:
    """before and after: the column in the row before and the row after, from one fold."""
    part = cut(rows, segment).withColumn("__held", F.struct(F.col(column).alias("x")))
    at = F.struct(*order)
    ends = part.groupBy(*by, "__segment").agg(F.min_by("__held", at).alias("__first"), F.max_by("__held", at).alias("__last"))
    over = along(by)
    ends = ends.withColumns({"__last": F.lag("__last").over(over), "__first": F.lead("__first").over(over)})
    ends = ends.select(*by, "__segment", F.explode(F.array(F.struct(F.lit(1).alias("__carry"), F.col("__last").alias("__held")), F.struct(F.lit(-1).alias("__carry"), F.col("__first").alias("__held")))).alias("x"))
    both = part.withColumn("__carry", F.lit(0)).unionByName(ends.select(*by, "__segment", "x.*"), allowMissingColumns=True)
    w = inside(by, order)
    return ended(both.withColumns({"before": F.lag("__held").over(w)["x"], "after": F.lead("__held").over(w)["x"]}))
