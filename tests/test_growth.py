"""Steps whose shuffles must grow no faster than their input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.functions.udfs import needles
from talkframe.operators import evidence as V
from talkframe.operators import messages as M
from talkframe.operators import mining as N
from talkframe.plans import streams


def said(spark, rows):
    """Messages of (conv_id, seq, speaker, text)."""
    df = spark.createDataFrame(rows, "conv_id string, seq long, speaker string, text string")
    return M.messages(df, **{c: F.col(c) for c in df.columns})


def shuffled(spark, df):
    """Rows of df, and the records that are shuffled for them where no table is small enough to broadcast."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before, small = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    return rows, sum(n for k, n in written().items() if k not in before)


@pytest.mark.parametrize("block", [16, 100_000])
def test_contained_is_what_the_joined_lines_contain(spark, block):
    r = random.Random(3)
    word = lambda k: "".join(r.choice("ab\U0001d518 c") for _ in range(k))
    rows = [(conv, i, "x", "\n".join(word(r.randint(0, 9)) for _ in range(r.randint(1, 4)))) for conv, size in (("a", 40), ("b", 3), ("c", 1)) for i in range(size)]
    claims = [(conv, i, word(r.randint(1, 12)) + (", " + word(r.randint(1, 9)) if i % 3 else "")) for conv in "abcd" for i in range(120)]
    m = said(spark, rows)
    lines = V.corpus_lines(m)
    flat = {}
    for x in sorted(lines.collect(), key=lambda x: x["line_id"]):
        flat[x["conv_id"]] = flat.get(x["conv_id"], "") + x["norm"]
    want = {(c, i) for c, i, t in claims if any(len(n) >= 2 and n in flat.get(c, "") for n in needles(t, {"x"}))}
    got = V.contained(spark.createDataFrame(claims, "conv_id string, claim_id long, claim string"), m, lines, block).collect()
    assert len(got) == len(want) and {(x["conv_id"], x["claim_id"]) for x in got} == want and 20 < len(want) < 460


def test_contained_shuffles_lines_and_forms_not_their_grams(spark):
    m = said(spark, [("c", i, "x", "ab" * 100) for i in range(50)])
    claims = spark.createDataFrame([("c", i, "ab" * 60) for i in range(20)], "conv_id string, claim_id long, claim string")
    rows, records = shuffled(spark, V.contained(claims, m, V.corpus_lines(m)))
    assert len(rows) == 20 and records < 500


def test_phrases_shuffle_lines_and_not_their_grams(spark):
    r = random.Random(4)
    rows = [(f"c{i % 5}", i, "xy"[i % 2], "".join(r.choice("abcdefgh") for _ in range(150))) for i in range(200)]
    lines = N.message_lines(said(spark, rows))
    found, records = shuffled(spark, N.absorbed(N.gram_counts(lines), 3, 60))
    assert len(found) > 500 and records < 2000
    counted, records = shuffled(spark, N.gram_counts(lines, noise=("zz",)))
    assert sum(x["n"] for x in counted) == sum(150 - n + 1 for n in range(2, 6)) * 200 and records < 2000


def test_grams_without_limits_shuffle_lines_and_not_their_grams(spark):
    r = random.Random(5)
    rows = [(f"c{i % 5}", i, "xy"[i % 2], "".join(r.choice("abcdefgh") for _ in range(3 * i))) for i in range(1, 100)] + [("c0", 100, "x", "".join(r.choice("ab\U0001d518") for _ in range(50_000)))]
    want = Counter((c, s, t[i:i + n]) for c, _, s, t in rows for n in range(2, 6) for i in range(len(t) - n + 1))
    counted, records = shuffled(spark, N.gram_counts(N.message_lines(said(spark, rows)), longest_line=None, budget=None, noise=("zz",)))
    assert {(x["conv_id"], x["speaker"], x["gram"]): x["n"] for x in counted} == {k: n for k, n in want.items()} and records < 2000


@pytest.mark.parametrize("size", [0, 1, 31, 32, 33, 36, 1023, 1024, 1025, 1028, 1029, 2048, 3077])
def test_pieces_give_each_gram_once(spark, size):
    r = random.Random(size)
    t = "".join(r.choice("ab\u00e9\U0001d518") for _ in range(size))
    got = spark.createDataFrame([(t,)], "t string").select(X.ngrams("t", 1, 5)).first()[0]
    assert Counter(got) == Counter(t[i:i + n] for n in range(1, 6) for i in range(size - n + 1))


def test_lines_are_dealt_out_by_their_characters(spark, monkeypatch):
    monkeypatch.setattr(N, "CHARS", 1000)
    rows = said(spark, [(f"c{i}", i, "x", "ab" * 50) for i in range(40)]).select("conv_id", "text")
    assert N.dealt(rows, "text", "conv_id").rdd.getNumPartitions() == 4


def test_parts_of_grams_go_within_their_group_only(spark):
    rows = [("a", "abc", 3, 0.5), ("a", "ab", 3, 0.25), ("a", "bc", 4, 1.0), ("b", "ab", 3, 2.0), (None, "abc", 3, 0.5), (None, "ab", 3, 0.75)]
    got = N.without_parts(spark.createDataFrame(rows, "conv_id string, gram string, n long, ratio double"), ["conv_id"], "gram")
    assert got.columns == ["conv_id", "gram", "n", "ratio"] and {tuple(x) for x in got.collect()} == {x for x in rows if x != rows[1]}


def test_grams_of_any_length_of_text(spark):
    for size in (0, 1, 2, 5, 31, 32, 33, 36, 63, 64, 65, 200):
        t = "".join(random.Random(size).choice("ab\U0001d518") for _ in range(size))
        got = spark.createDataFrame([(t,)], "t string").select(X.ngrams("t", 2, 6)).first()[0]
        assert sorted(got) == sorted(t[i : i + n] for n in range(2, 7) for i in range(size - n + 1))


def test_standing_phrases_go_along_with_their_texts(spark):
    r = random.Random(5)
    word = lambda k: "".join(r.choice("abc") for _ in range(k))
    texts = [(f"c{i % 3}", i, word(120)) for i in range(90)]
    phrases = sorted({(f"c{i % 4}", word(r.randint(2, 6))) for i in range(60)})
    want = sorted((c, i, p) for c, i, t in texts for d, p in phrases if c == d and p in t)
    t, p = spark.createDataFrame(texts, "conv_id string, seq long, text string"), spark.createDataFrame(phrases, "conv_id string, phrase string")
    for at_once in (4, 512):
        found = N.standing_in(p, t, "phrase", "text", at_once)
        assert sorted((x["conv_id"], x["seq"], x["phrase"]) for x in found.collect()) == want
    rows, records = shuffled(spark, N.standing_in(p, t.repartition(8), "phrase", "text"))
    assert len(rows) == len(want) and records < 400


def test_distinctive_clauses_are_counted_in_one_pass(spark):
    rows = [("c", i, "xy"[i % 2], ("well now, " if i % 4 else "so it is, ") + "abcd " * 20) for i in range(60)]
    sides = spark.createDataFrame([("c", "x", "y")], "conv_id string, target string, counterpart string")
    found, records = shuffled(spark, N.distinctive(said(spark, rows), sides, expressive=False, noise=("zz",)))
    assert {(x["phrase"], x["n"]) for x in found} == {("so", 15), ("it", 15), ("is", 15)} and records < 2000


def test_topics_count_whole_conversations_and_shuffle_few_grams(spark):
    r = random.Random(6)
    word = lambda k: "".join(r.choice("abcdefghijklmn") for _ in range(k))
    rows = [("long", i * 3000, "x", word(6) + "qrs" * (i % 3 == 0)) for i in range(30)] + [(f"c{i // 4}", i, "x", word(300)) for i in range(80)] + [(None, i * 9000, "x", "tuv") for i in range(12)]
    found, records = shuffled(spark, N.topics(said(spark, rows), cjk=False))
    got = {(x["conv_id"], x["gram"]): x["n"] for x in found}
    text = {}
    for c, _, _, t in rows:
        text.setdefault(c, []).append(t)
    assert got[("long", "qrs")] == 10 and got[(None, "tuv")] == 12 and records < 5000
    assert got == {(c, g): n for (c, g), n in got.items() if n == sum(t[i : i + len(g)] == g for t in text[c] for i in range(len(t))) and n >= 10}
    ranks = sorted(x["rank"] for x in found if x["conv_id"] == "c3")
    assert ranks == list(range(1, len(ranks) + 1))


def test_examples_of_many_groups_are_picked_without_a_call_a_group(spark):
    rows = [(f"c{i % 700}" if i % 9 else None, i, ("x", "y", None)[i % 3], f"line {i * 7919 % 1000} of them") for i in range(4000)]
    m = said(spark, rows)
    found = N.examples(m)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.collect()), key=str)
    want = []
    for key in {(c, s) for c, _, s, _ in rows}:
        kept = []
        for _, i, _, t in sorted((r for r in rows if (r[0], r[2]) == key), key=lambda r: (-0.04 * len(r[3]), r[1])):
            if len(kept) < 8 and not any(t in k or k in t or t[:3] == k[:3] for _, k in kept):
                kept.append((i, t))
        want += [(key[0], i, key[1], t, 0.5 + 0.04 * len(t), k) for k, (i, t) in enumerate(kept, 1)]
    assert len(got) == len(want) > 700 and [x[:4] + x[5:] for x in got] == [x[:4] + x[5:] for x in sorted(want, key=str)]


def test_arrivals_are_written_by_all_tasks_and_come_a_part_at_a_time(spark, tmp_path):
    m = said(spark, [("c", i, "x", "t") for i in range(40)]).repartition(4)
    seen = []
    run = lambda rows: rows.writeStream.foreachBatch(lambda b, k: seen.append((k, b.count()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    streams.arriving(m, f"{tmp_path}/in", ["seq < 8", "seq < 0", "seq >= 0"], run)
    assert [n for _, n in seen if n] == [8, 40] and len(list((tmp_path / "in").glob("part-*"))) > 3
