"""Queries that run as streams over what the tables hold now."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe.operators import messages as M
from talkframe.plans.base import chat_sides, chats, ev, query
from talkframe.plans.changes import MARKS
from talkframe.plans.exchanges import ALTERNATE, ALTERNATE_LAB, MOST, coverage_sql
from talkframe.streaming import increments as I
from talkframe.streaming.folders import drained, shared_folder
from talkframe.streaming.sessions import expiring_sessions

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(m, path: str, parts: list):
    """A stream of the messages of each condition, one after another, a micro-batch for each file."""
    for part in parts:
        m.where(part).coalesce(1).write.mode("append").parquet(path)
    return m.sparkSession.readStream.schema(M.SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def arriving(m, path: str, parts: list, run) -> None:
    """The messages of each condition arrive in as many files as there are tasks: `run` takes a stream of them as far as it goes, a micro-batch for each."""
    for part in parts:
        m.where(part).write.mode("append").parquet(path)
        run(m.sparkSession.readStream.schema(M.SCHEMA).parquet(path))


@query("SELECT conv_id, seq, min(seq) OVER (PARTITION BY conv_id, session_id) AS opened FROM ev_s")
def r04_expiring_sessions(spark, sf):
    """The events arrive in four parts by time, each a micro-batch; sessions that the watermark has passed are dropped."""
    path = shared_folder(spark, "sessions")
    ev(spark, sf).write.parquet(f"{path}/messages")  # numbered once, and not in the one task that writes a part
    m = spark.read.schema(M.SCHEMA).parquet(f"{path}/messages")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = m.select(F.percentile_approx(us, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias("c")).first()["c"] or [0, 0, 0]
    ends = [None, *cuts, None]
    parts = [(F.lit(True) if a is None else us > a) & (F.lit(True) if b is None else us <= b) for a, b in zip(ends, ends[1:])]
    had = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return drained(expiring_sessions(arrivals(m, f"{path}/in", parts)), path)
    finally:
        spark.conf.set(_STORE, had)


def merged(spark, sf):
    """A folder into which the conversations came as three exports, each with all that was said until then, and the last one twice."""
    m, path = chats(spark, sf), shared_folder(spark, "increments")
    facts = m.where("seq <= 2 AND conv_id <> 'zh'").select("conv_id", F.col("seq").alias("memory_id"), F.lit("fact").alias("status"), F.col("text").alias("quote"))
    I.begin(m.where("seq <= 2"), path, facts)
    rules = {"marks": MARKS, "cjk": False}
    arriving(m, f"{path}/in", ["seq <= 4", "seq <= 5", "seq > 0"], lambda rows: I.merging(rows, path, **rules).awaitTermination())
    last = I.messages_of(spark, path).agg(F.max("batch")).first()[0]
    I.merge_batch(m, last, path, **rules)  # a replay changes nothing
    return path


@query("SELECT conv_id, seq, ts, speaker, text, reply_to FROM chats")
def r01_streamed_increments(spark, sf):
    return I.messages_of(spark, merged(spark, sf)).select("conv_id", "seq", "ts", "speaker", "text", "reply_to")


@query("""WITH f AS (SELECT DISTINCT conv_id, seq AS memory_id, substr(text, pos, 2) AS gram FROM (SELECT conv_id, seq, text, unnest(range(1, length(text))) AS pos FROM cv WHERE seq <= 2) WHERE regexp_full_match(substr(text, pos, 2), '[a-z]{2}'))
    SELECT DISTINCT a.conv_id, memory_id, seq AS message, text AS quote FROM cv a JOIN f ON f.conv_id = a.conv_id AND contains(a.text, gram) WHERE a.seq > 2 AND (contains(text, 'not') OR contains(text, 'pas') OR contains(text, 'nicht'))""")
def r01_streamed_conflicts(spark, sf):
    return I.conflicts_of(spark, merged(spark, sf)).drop("batch")


@query(coverage_sql(ALTERNATE_LAB, "chats", "sides", ALTERNATE))
def r02_rebuilt_coverage(spark, sf):
    """Coverage as it follows from the merged messages."""
    none = spark.createDataFrame([], "conv_id string, item_id long, section string, text string, claim string")
    got = I.rebuilt(spark, merged(spark, sf), chat_sides(spark, sf), none, none, lambda added: none, situations=ALTERNATE, most_chars=MOST)
    return got.coverage
