"""Table functions for SQL. They are SQL themselves, so that a query which calls them stays in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

NGRAMS = """CREATE OR REPLACE TEMPORARY FUNCTION ngrams(text STRING, lo INT, hi INT)
RETURNS TABLE (at INT, gram STRING)
COMMENT 'Character n-grams of lo to hi characters, with the place that each begins at (from 1). A null text gives none; neither does hi below lo.'
RETURN SELECT g.at, g.gram FROM (SELECT explode(flatten(transform(
    CASE WHEN lo <= hi AND hi >= 1 THEN sequence(greatest(lo, 1), hi) ELSE CAST(array() AS ARRAY<INT>) END,
    n -> CASE WHEN length(text) >= n THEN transform(sequence(1, length(text) - n + 1), i -> named_struct('at', i, 'gram', substring(text, i, n)))
        ELSE CAST(array() AS ARRAY<STRUCT<at: INT, gram: STRING>>) END))) AS g)"""


def register(spark: SparkSession) -> None:
    """Make the functions known to the session: `SELECT gram FROM t, LATERAL ngrams(t.text, 2, 3)`."""
    spark.sql(NGRAMS)
