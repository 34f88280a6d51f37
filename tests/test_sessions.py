from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkframe.operators import messages as M
from talkframe.operators import profile as P
from talkframe.operators import scans
from talkframe.operators import sessions as S
from talkframe.plans.base import ZH, zh
from talkframe.streaming.sessions import number, stream_sessions

T0 = datetime(2024, 1, 1, 12)


def chat(spark, rows):
    """rows: (minutes or None, speaker, text)."""
    return spark.createDataFrame([("c", i, None if at is None else T0 + timedelta(minutes=at), who, text, "", "") for i, (at, who, text) in enumerate(rows, 1)], M.SCHEMA)


def sessions_of(rows, gap=30):
    last, n, out = None, 0, []
    for at in rows:
        if at is not None:
            n += last is not None and (at < last or at - last > gap)
            last = at
        out.append(n)
    return out


@pytest.mark.parametrize("times", [[0, 30, 60.5, 91], [0, None, 20, 10, None, 45], [None, None, 5], [5, 5, 36]])
def test_sessions(spark, times):
    got = S.with_sessions(chat(spark, [(t, "a", "x") for t in times])).orderBy("seq").collect()
    assert [r["session_id"] for r in got] == sessions_of(times)


@given(st.lists(st.one_of(st.none(), st.integers(0, 200)), max_size=30), st.lists(st.integers(0, 30), max_size=3))
@settings(max_examples=100, deadline=None)
def test_streamed_numbers_equal_the_batch_rule(times, cuts):
    rows = [(i, None if t is None else t * 60_000_000) for i, t in enumerate(times)]
    out, last, session = [], None, 0
    for a, b in zip([0, *sorted(cuts)], [*sorted(cuts), len(rows)], strict=True):
        part, last, session = number(rows[a:b], last, session, 30 * 60_000_000)
        out += part
    assert [s for _, s in out] == sessions_of(times)


def test_streaming_sessions(spark, tmp_path):
    for n, part in enumerate((ZH[:17], ZH[17:30], ZH[30:])):
        spark.createDataFrame(part, M.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b={n}"))
    stream = spark.readStream.schema(M.SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/b=*"))
    q = stream_sessions(stream).writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["seq"]: r["session_id"] for r in spark.table("sessions").collect()}
    want = {r["seq"]: r["session_id"] for r in S.with_sessions(zh(spark)).collect()}
    assert got == want


def test_runs_stop_at_sessions_and_speakers(spark):
    got = S.runs(chat(spark, [(0, "a", "1"), (1, "a", "2"), (2, "b", "3"), (50, "b", "4"), (51, "a", "5")])).orderBy("first_seq").collect()
    assert [(r["session_id"], r["run_id"], r["speaker"], r["lines"]) for r in got] == [(0, 0, "a", ["1", "2"]), (0, 1, "b", ["3"]), (1, 0, "b", ["4"]), (1, 1, "a", ["5"])]


def test_reply_gaps_and_bursts(spark):
    m = chat(spark, [(0, "a", "x"), (5, "b", "x"), (6, "b", "x"), (36.5, "a", "x"), (36.5, "b", "x"), (30, "a", "x"), (None, "b", "x"), (31, "b", "x")])
    assert [(r["seq"], r["speaker"], r["gap"]) for r in S.reply_gaps(m).orderBy("seq").collect()] == [(2, "b", 5.0), (5, "b", 0.0)]
    assert [r["seq"] for r in S.with_burst(m).where("burst").orderBy("seq").collect()] == [3, 8]


def test_profile_counts_midnight_and_questions(spark):
    rows = [(660, "a", "在吗？"), (661, "b", "在 [偷笑]"), (1079, "b", "five fifty nine"), (1080, "b", "six")]
    got = {r["speaker"]: r for r in P.speaker_profile(chat(spark, rows)).collect()}
    assert (got["a"]["late_night"], got["b"]["late_night"], got["a"]["question_ratio"], got["b"]["emoji_ratio"]) == (1, 2, 100.0, 33.3)
    assert got["b"]["reply_gap"] == 1.0 and got["b"]["sessions_started"] == 1 and got["b"]["burst_ratio"] == 33.3


def test_target_ties_go_to_who_spoke_first(spark):
    m = chat(spark, [(0, "b", "x"), (1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "我", "x")])
    assert P.targets(m).collect()[0]["target"] == "b"
    assert P.counterparts(m).collect()[0]["counterpart"] == "a"


@given(st.lists(st.integers(0, 1800), min_size=1, max_size=40))
@settings(max_examples=5, deadline=None)
def test_gap_summary_matches_python(spark, seconds):
    import statistics

    rows, at = [], 0.0
    for s in seconds:
        rows += [(at, "a", "x"), (at + s / 60, "b", "x")]
        at += 100
    got = P.gap_summary(chat(spark, rows)).where("speaker = 'b'").collect()[0]
    gaps = sorted(s / 60 for s in seconds)
    assert got["gaps"] == len(gaps) and abs(got["median_gap"] - statistics.median(gaps)) < 1e-4
    assert abs(got["high_gap"] - gaps[round(0.9 * (len(gaps) - 1))]) < 1e-4


def test_message_index_is_stable(spark):
    a = S.message_index(zh(spark)).orderBy("index").collect()
    b = S.message_index(zh(spark).repartition(5)).orderBy("index").collect()
    assert a == b and len({r["id"] for r in a}) == len(a)
    assert a[0]["time"] == "2024-03-01T09:00:00" and a[0]["session"] == 1 and a[31]["time"] is None


def test_windows_stay_in_the_jvm(spark):
    plan = P.speaker_profile(zh(spark).withColumn("x", F.lit(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def runs_of(rows, sessions):
    out, n = [], 0
    for i, who in enumerate(rows):
        if i and sessions[i] != sessions[i - 1]:
            n = 0
        elif i and rows[i - 1] is not None and who is not None and rows[i - 1] != who:
            n += 1
        out.append(n)
    return out


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 90)), st.sampled_from(["a", "b", None])), min_size=1, max_size=60), st.sampled_from([1, 2, 5, 100]))
@settings(max_examples=25, deadline=None)
def test_segmented_sessions_and_runs(spark, rows, size):
    """Whatever a segment holds: no time, one row, a session that began segments ago."""
    m = chat(spark, [(t, who, "x") for t, who in rows]).unionByName(chat(spark, [(0, "z", "y")] * 3).withColumn("conv_id", F.lit(None).cast("string")))
    got = S.with_runs(m, size=size).where("conv_id = 'c'").orderBy("seq").collect()
    want = sessions_of([t for t, _ in rows])
    assert [r["session_id"] for r in got] == want and [r["run_id"] for r in got] == runs_of([who for _, who in rows], want)
    assert S.with_runs(m, size=size).where("conv_id IS NULL").agg(F.max("run_id"), F.count("*")).first() == (0, 3)


@given(st.lists(st.integers(-40, 40), min_size=1, max_size=30, unique=True), st.sampled_from([1, 3, 50]))
@settings(max_examples=10, deadline=None)
def test_scans_equal_windows(spark, seqs, size):
    df = spark.createDataFrame([("g", s, s * s % 7) for s in seqs], "g string, seq long, v long")
    segment = scans.by_number(size=size)
    order = sorted(seqs)
    vs = [s * s % 7 for s in order]
    numbered = scans.numbered(df, "n", ["g"], ["seq"], segment).orderBy("seq").collect()
    assert [r["n"] for r in numbered] == list(range(1, len(order) + 1)) and set(numbered[0].asDict()) == {"g", "seq", "v", "n"}
    assert [r["total"] for r in scans.running_sum(df, "total", F.col("v"), ["g"], ["seq"], segment).orderBy("seq").collect()] == [sum(vs[: i + 1]) for i in range(len(vs))]
    assert [(r["before"], r["after"]) for r in scans.around(df, "v", ["g"], ["seq"], segment).orderBy("seq").collect()] == list(zip([None, *vs[:-1]], [*vs[1:], None], strict=True))
    assert [r["x"] for r in scans.beside(df, {"x": "v"}, ["g"], ["seq"], segment, after=True).orderBy("seq").collect()] == [*vs[1:], None]
    assert scans.numbered(df.limit(0), "n", ["g"], ["seq"], segment).count() == 0


def test_a_million_messages_of_one_conversation_are_many_tasks(spark):
    """Sessions and runs of one conversation, spread over all partitions; no window orders it as a whole."""
    n = 1_000_000
    m = spark.range(n, numPartitions=8).select(
        F.lit("c").alias("conv_id"), (F.col("id") + 1).alias("seq"), F.timestamp_micros(F.col("id") * 60_000_000 + F.floor(F.col("id") / 1000) * 3_600_000_000).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("speaker"), F.lit("x").alias("text"), F.lit("").alias("source_id"), F.lit("").alias("reply_to"),
    )
    out = S.with_runs(m).select("seq", "session_id", "run_id")
    wrong = out.where((F.col("session_id") != F.floor((F.col("seq") - 1) / 1000)))
    assert wrong.count() == 0
    per = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(per) >= 4 and max(r["count"] for r in per) < 0.6 * n
    assert out.where("seq % 1000 = 0").agg(F.min("run_id"), F.max("run_id")).first() == (666, 666)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # windows over the rows are over segments; those over a conversation see folded rows only
    assert all("__segment" in line for line in plan.splitlines() if "windowspecdefinition" in line)
