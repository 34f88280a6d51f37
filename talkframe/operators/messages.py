"""The messages frame: conv_id, seq, ts, speaker, text, source_id, reply_to. seq orders a conversation, never ts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkframe.operators import scans

SCHEMA = T.StructType([
    T.StructField("conv_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()), T.StructField("source_id", T.StringType()), T.StructField("reply_to", T.StringType()),
])


def in_order(*more: str) -> WindowSpec:
    return Window.partitionBy("conv_id", *more).orderBy("seq")


def message_at(m: DataFrame, index: Column | int) -> DataFrame:
    """The message of each conversation with this number."""
    return m.where(F.col("seq") == index)


def with_ordinals(rows: DataFrame, by: list[str], order: str = "seq", name: str = "ordinal") -> DataFrame:
    """Rows numbered from 1 within their group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def with_speaker(m: DataFrame) -> DataFrame:
    """Messages whose speaker has a name."""
    return m.where(F.trim(F.coalesce("speaker", F.lit(""))) != "")


def counted(m: DataFrame, column: str = "speaker", most: int | None = None) -> DataFrame:
    """Per conversation a map of a column's values to their numbers, the `most` frequent ones; ties go to the first in code-point order."""
    by = m.groupBy("conv_id", column).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), column)))
    kept = entries if most is None else F.slice(entries, 1, most)
    return by.groupBy("conv_id").agg(F.map_from_entries(F.transform(kept, lambda x: F.struct(x[column], -x["less"]))).alias("counts"))


def messages(df: DataFrame, **columns: Column) -> DataFrame:
    """A messages frame from columns by name; missing ones are null timestamps and empty strings."""
    default = {"ts": F.lit(None), "source_id": F.lit(""), "reply_to": F.lit("")}
    return df.select(*((columns.get(f.name, default.get(f.name))).cast(f.dataType).alias(f.name) for f in SCHEMA.fields))


def from_conversations(df: DataFrame) -> DataFrame:
    return messages(df, conv_id=F.col("conv_id"), seq=F.col("turn") + 1, speaker=F.col("role"), text=F.col("text"))


def from_events(df: DataFrame) -> DataFrame:
    """A conversation for every ten users; event types speak."""
    # numbered day by day, so that a conversation may be of any length
    numbered = scans.numbered(df.withColumn("conv", F.floor(F.col("user_id") / 10)), "n", ["conv"], ["ts", "event_id"], F.to_date("ts"))
    return messages(numbered, conv_id=F.col("conv"), seq=F.col("n"), ts=F.col("ts"), speaker=F.col("event_type"), text=F.col("props"), source_id=F.col("event_id"))


def from_documents(df: DataFrame) -> DataFrame:
    """A conversation for every source; languages speak."""
    return messages(df, conv_id=F.col("source"), seq=F.col("doc_id"), speaker=F.col("lang"), text=F.col("text"))
