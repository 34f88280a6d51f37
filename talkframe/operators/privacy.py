"""Redaction and scans for personal data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X


def redact(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, X.redacted(column))


def scan(files: DataFrame, rules: Sequence[tuple[str, str, str, str]] = L.PRIVACY_RULES) -> DataFrame:
    """Files (file, text) by line and rule: the first match, its severity and redacted form, and a stable id."""
    lines = files.select("file", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("line", "content")).withColumn("line", F.col("line") + 1)
    parts = [
        F.when(F.col("content").rlike(_unicode(p)), F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.left(F.regexp_extract("content", _unicode(p), 0), F.lit(120)).alias("text"), F.lit(a).alias("suggestion")))
        for c, p, s, a in rules
    ]
    hits = lines.select("file", "line", "content", F.explode(F.array_compact(F.array(*parts))).alias("x")).select("file", "line", "content", "x.*")
    key = F.concat_ws(":", "file", F.col("line").cast("string"), "category", "content")
    return hits.select(F.left(F.sha2(key.cast("binary"), 256), F.lit(16)).alias("id"), "file", "line", "category", "severity", "text", X.redacted("text").alias("redacted"), "suggestion")


def _unicode(pattern: str) -> str:
    return f"(?U){pattern}" if r"\w" in pattern else pattern


def risk(items: DataFrame) -> DataFrame:
    """Per file the worst severity."""
    return items.groupBy("file").agg(F.when(F.bool_or(F.col("severity") == "high"), "high").otherwise("medium").alias("risk"), F.count("*").alias("items"))


def with_confirmations(items: DataFrame, confirmed: DataFrame, fingerprint: str) -> DataFrame:
    """Items with `confirmed`: those whose id was confirmed under the same fingerprint."""
    ids = confirmed.where(F.col("fingerprint") == fingerprint).select("id").distinct().withColumn("confirmed", F.lit(True))
    return items.join(ids, "id", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
