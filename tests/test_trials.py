from datetime import datetime, timedelta

import pytest

from talkframe.functions import lexicon as L
from talkframe.functions import tables
from talkframe.operators import changes as C
from talkframe.operators import messages as M
from talkframe.operators import trials as T


def grams(text, lo, hi):
    return sorted((i + 1, text[i : i + n]) for n in range(max(lo, 1), hi + 1) for i in range(len(text) - n + 1)) if text else []


@pytest.mark.parametrize("text,lo,hi", [("abcd", 2, 3), ("", 1, 2), (None, 1, 2), ("a", 2, 2), ("你好吗a", 1, 5), ("ab", 3, 2), ("ab", -2, 0), ("ab", 0, 1)])
def test_ngram_table(spark, text, lo, hi):
    tables.register(spark)
    got = spark.sql("SELECT g.* FROM (SELECT CAST(:t AS STRING) AS text) AS t, LATERAL ngrams(t.text, :lo, :hi) AS g", args={"t": text, "lo": lo, "hi": hi}).collect()
    assert sorted(map(tuple, got)) == grams(text, lo, hi)


def test_a_new_reply_drops_the_vote(spark):
    run = spark.createDataFrame([("c", "1", "b", "a"), ("c", "2", "a", "b"), ("d", "1", "a", "b"), (None, "1", "a", "b")], "conv_id string, id string, first string, second string")
    kinds = "conv_id string, id string, side string, passed boolean, seconds double, at int"
    told = [("c", "1", "a", True, 1.25, 1), ("c", "1", "b", None, None, 1), ("c", "2", "a", False, 2.0, 1), ("c", "2", "b", True, 0.5, 1), ("d", "1", "a", True, 1.0, 1), ("d", "1", "b", True, 1.0, 1)]
    votes = spark.createDataFrame([("c", "1", "a", 2), ("c", "2", "a", 2), ("d", "1", "tie", 2), ("d", "1", "x", 3)], "conv_id string, id string, choice string, at int")
    results = spark.createDataFrame(told, kinds)
    chosen = T.choices(run, results, votes)
    assert sorted(map(tuple, chosen.collect())) == [("c", "1", "b"), ("c", "2", "a"), ("d", "1", "tie")]
    assert sorted(map(tuple, T.summary(run, results, chosen).collect())) == [("c", "a", 1, 1, 3.2), ("c", "b", 1, 1, 0.5), ("d", "a", 0, 1, 1.0), ("d", "b", 0, 1, 1.0)]
    again = spark.createDataFrame([*told, ("c", "1", "a", False, 9.0, 5)], kinds)
    chosen = T.choices(run, again, votes)
    assert sorted(map(tuple, chosen.collect())) == [("c", "2", "a"), ("d", "1", "tie")]
    assert {r["conv_id"] for r in T.summary(run, again, chosen).collect()} == {"d"}
    assert T.summary(run, results.limit(0), T.choices(run, results.limit(0), votes)).collect() == []
    assert sorted(map(tuple, T.choices(run, results.drop("at"), votes).collect())) == [("c", "1", "b"), ("c", "2", "a"), ("d", "1", "tie")]
    marked = run.withColumn("fingerprint", run["id"])
    now = spark.createDataFrame([("c", "1"), ("d", "2")], "conv_id string, fingerprint string")
    assert [(r["conv_id"], r["id"]) for r in T.fresh_runs(marked, now).collect()] == [("c", "1")]


def test_holdout_keys_and_moves(spark):
    day = datetime(2024, 3, 1, 9)
    said = [("c", 2 * s + i + 1, day + timedelta(hours=2 * s, minutes=i), "ab"[i], f"text {s} {i}", "", "") for s in range(5) for i in range(2)]
    m = spark.createDataFrame([*said, ("few", 1, day, "a", "x", "", "")], M.SCHEMA)
    keys = T.holdout_keys(m, 40).collect()
    test = C.holdout(m, 40).where("test").collect()
    assert {(r["conv_id"], r["seq"]) for r in keys} == {(r["conv_id"], r["seq"]) for r in test} and len(keys) == 4 and len({r["key"] for r in keys}) == 4
    sides = spark.createDataFrame([("c", "b", "a")], "conv_id string, target string, counterpart string")
    cases = T.holdout_cases(m, sides, 40).collect()
    assert len(cases) == 2 and {r["expected_move"] for r in cases} == {L.HOLDOUT_MOVE}
    with pytest.raises(ValueError, match="few has 1"):
        T.require_sessions(m, 40)
    T.require_sessions(m, 0)
    T.require_sessions(m.where("conv_id = 'c'"), 40)
