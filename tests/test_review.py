import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from talkframe.operators import layer as Y
from talkframe.operators import messages as M
from talkframe.operators import packs as K
from talkframe.operators import review as R
from talkframe.operators import trials as T
from talkframe.plans import review as Q
from talkframe.plans.base import zh


def test_gate_reasons(spark, sf):
    got = {r["item_id"]: r["why"] for r in Q.v11_quality_gate(spark, sf).collect()}
    assert got == {1: "generic", 2: None, 3: "no_quote", 4: "rule", 5: "rule", 6: None, 7: None, 8: "no_pair", 9: None, 10: None, 11: "not_said", 12: "report_line", 13: None}


def test_decisions_need_their_fields(spark, sf):
    got = {r["ordinal"]: r["text"] for r in Q.v18_decisions(spark, sf).collect()}
    assert got == {2: "人工修订（适用范围：私聊）：常说下次", 3: "爱说「没说过」"}


def test_answers_expire_and_are_redacted(spark, sf):
    got = {r["id"]: (r["status"], r["note"]) for r in Q.v17_answers(spark, sf).collect()}
    assert got["specificity-3"] == ("confirmed", "打 [手机号]") and got["specificity-4"] == ("pending", "") and got["coverage-对方要求正经一点"] == ("pending", "")


def test_case_pool_has_one_a_prompt(spark, sf):
    rows = Q.q10_case_pool(spark, sf).collect()
    assert len({r["prompt"] for r in rows if r["origin"] == "feedback"}) == len([r for r in rows if r["origin"] == "feedback"]) and any(r["origin"] == "package" for r in rows)


def test_checks(spark, sf):
    rows = Q.q09_checks(spark, sf).collect()
    assert any(r["reasons"] == ["service_phrase"] for r in rows) and any(r["checked"] is False for r in rows) and any(r["quote_grounded"] for r in rows if r["checked"])


def test_transcript_keeps_the_newest_and_what_still_fits(spark):
    rows = spark.createDataFrame([("c", m, n, b) for m, n, b in (("2024-01", 1, 10), ("2024-02", 1, 500), ("2024-03", 1, 90))], "conv_id string, month string, messages long, bytes long")
    real, K.months = K.months, lambda m: rows
    try:
        assert {r["month"]: r["kept"] for r in K.transcript(None, 100).collect()} == {"2024-01": True, "2024-02": False, "2024-03": True}
        assert {r["month"]: r["kept"] for r in K.transcript(None, 0).collect()} == {"2024-01": False, "2024-02": False, "2024-03": True}
    finally:
        K.months = real


def test_months_are_written_in_order(spark, tmp_path):
    K.write_months(zh(spark).repartition(3), str(tmp_path / "t"))
    files = list((tmp_path / "t").rglob("part-*"))
    lines = [x for f in files if "2024-03" in str(f) for x in f.read_text().splitlines()]
    assert lines[0] == "2024-03-01 09:00 小雨：今天有空吗" and len(lines) > 30


def test_samples_respect_the_budget(spark):
    target = spark.createDataFrame([("zh", "阿木")], "conv_id string, target string")
    rows = K.samples(zh(spark), target, 500, 250).orderBy("rank").collect()
    assert rows and sum(len(r["body"]) for r in rows) + 7 * (len(rows) - 1) <= 500 and all("阿木:" in r["body"] for r in rows)
    assert [(r["session_id"], r["window_id"]) for r in rows] == sorted((r["session_id"], r["window_id"]) for r in rows)
    assert K.samples(zh(spark), target, 60).count() == 0


def test_spread_choice_equals_valuing_all_each_time():
    rng = random.Random(5)
    for _ in range(40):
        units = [(rng.randrange(0, 41) / 40, (rng.choice("abc"), rng.choice("xy"), rng.randrange(4)), rng.randrange(20, 200)) for _ in range(rng.randrange(0, 30))]
        budget, left, out, used = rng.randrange(0, 900), list(range(len(units))), [], 0
        while left:
            seen = lambda j, k: sum(units[o][1][j] == units[k][1][j] for o in out)  # noqa: E731, B023
            best = min(left, key=lambda k: (-(units[k][0] - 3 * seen(0, k) - 3 * seen(1, k) - 4 * seen(2, k)), k))
            left.remove(best)
            cost = units[best][2] + 7 * bool(out)
            if used + cost <= budget:
                used += cost
                out.append(best)
        assert K.spread_choice(units, budget, 7, (3, 3, 4)) == out
    assert K.window_numbers([10, 9, 30, 5, 4, 25, 1], 20) == [0, 0, None, 1, 1, None, 2]


def test_packs_are_whole_or_absent(tmp_path):
    root = tmp_path / "pack"
    archive = K.write_pack(root, {"a.md": "one", "sub/b.bin": b"\0", "empty.md": ""})
    assert archive.is_file() and sorted(K.listing(root)) == ["a.md", "sub/b.bin"]
    (root / "mine.txt").write_text("user")
    first = K.snapshot(root)
    K.write_pack(root, {"a.md": "two"})
    assert sorted(K.listing(root)) == ["a.md", "mine.txt"] and json.loads((root / ".state/current.json").read_text())["files"] == ["a.md"]
    with pytest.raises(ValueError):
        K.write_pack(root, {"../x": "y"})
    assert (root / "a.md").read_text() == "two"
    K.rollback(root, first)
    assert (root / "a.md").read_text() == "one" and K.snapshot(root) == first
    (root / ".state/versions" / first / "files/a.md").write_text("changed")
    with pytest.raises(ValueError):
        K.rollback(root, first)


def test_checkpoints_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for inputs in ({"x": "1"}, {"x": "1"}, {"x": "2"}):
        assert K.checkpointed(spark, str(tmp_path), "stage", inputs, make).count() == 3
    assert len(made) == 2


def test_findings_mark_items(spark, sf):
    got = {r["item_id"]: r["text"] for r in Q.v07_applied(spark, sf).collect()}
    assert got[3] == "2023-07 和 5月6日 的事" and got[1] == "「下次一定」是固定说法"  # one month is too little to judge dates
    made = R.applied(spark.createDataFrame([("c", 1, "s", "t")], "conv_id string, item_id long, section string, text string"), spark.createDataFrame([("c", 1, "fuzzy"), ("c", 1, "verified")], "conv_id string, item_id long, status string"))
    assert made.collect()[0]["text"] == "t［fuzzy］"
    strict = R.applied(spark.createDataFrame([("c", 1, "s", "t")], "conv_id string, item_id long, section string, text string"), spark.createDataFrame([("c", 1, "fuzzy")], "conv_id string, item_id long, status string"), strict=True)
    assert strict.count() == 0 and Q.q15_feedback_rules(spark, sf).where(F.col("rule").contains("[手机号]")).count() == 1


def test_training_feedback_holds_every_document_against_the_benchmark(spark, tmp_path):
    from talkframe.plans import registry

    passage = "a passage of the benchmark that no document may contain"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, f"document {i} says {passage} in full" if i % 2 else f"document {i} says nothing of it") for i in range(10)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["id"] for r in registry.QUERIES["j13_training_feedback"](spark, str(tmp_path)).collect()) == [0, 2, 4, 6, 8]


def test_every_sentence_of_a_passage_is_matched(spark, tmp_path):
    from talkframe.plans import registry

    passage = "Nobody ever wrote about xylophones. the ferry leaves at noon tomorrow. Quartz jumps over vexed kings."
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    said = [(1, 0, "user", "when do we go"), (1, 1, "assistant", "I think the ferry leaves at noon tomorrow"), (2, 0, "user", "Quartz jumps over vexed kings")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["claim_id"], r["sentence"]): r for r in registry.QUERIES["j04_bigram_candidates"](spark, str(tmp_path)).collect()}
    assert set(got) == {(7, 0), (7, 1), (7, 2)}
    assert got[7, 0]["score"] < 1 and got[7, 1]["score"] == got[7, 2]["score"] == 1 and got[7, 1]["line_id"] != got[7, 2]["line_id"]


def test_versions_locks_and_inventory(tmp_path):
    root = tmp_path / "pack"
    K.write_pack(root, {"a.md": "one\ntwo", "b.json": "{}"})
    first = K.snapshot(root, "made")
    K.write_pack(root, {"a.md": "one\n2", "c.md": "new"})
    K.snapshot(root, "changed")
    assert [v["reason"] for v in K.versions(root)] == ["changed", "made"]
    d = K.difference(root, first)
    assert (d["added"], d["removed"], d["changed"], d["cut"]) == (["c.md"], ["b.json"], ["a.md"], []) and "-two" in d["diffs"]["a.md"] and "+2" in d["diffs"]["a.md"]
    assert K.difference(root, first, most=2)["cut"] == ["a.md"]
    assert K.inventory(root) == ["a.md", "c.md"]
    (root / ".state/current.json").unlink()
    assert K.inventory(root) == ["a.md", "c.md"] and K.inventory(tmp_path / "none") == []
    with K.locked(root), K.locked(root):
        pass


def test_logs_and_baselines(spark, tmp_path):
    schema = "conv_id string, at long, note string"
    log = str(tmp_path / "log")
    for k in range(3):
        T.append_log(spark.createDataFrame([("c", 10 * k + i, f"n{k}{i}") for i in range(4)], schema).coalesce(1), log)
    (tmp_path / "log" / "broken.json").write_text('{"conv_id": "c", "at": \n')
    assert [r["at"] for r in T.log_tail(spark, log, schema, "at", 5).collect()] == [23, 22, 21, 20, 13]
    assert T.log_tail(spark, log, schema, "at", 5, by="conv_id").count() == 5
    T.save_baseline(zh(spark), str(tmp_path / "base"), "v1")
    back = T.baseline(spark, str(tmp_path / "base"), "v1")
    assert back.columns == zh(spark).columns and back.count() == zh(spark).count() and back.where("text LIKE '%13800138000%'").count() == 0
    with pytest.raises(Exception):
        T.save_baseline(zh(spark), str(tmp_path / "base"), "v1")


def test_increment_marks_what_it_may_cancel(spark):
    from tests.test_exchanges import chat

    known = chat(spark, [(0, "a", "周末去公园"), (1, "b", "好")])
    incoming = chat(spark, [(0, "a", "周末去公园"), (9, "a", "公园取消了")])
    ledger = spark.createDataFrame([("c", 1, "plan"), ("c", 2, "fact")], "conv_id string, memory_id long, status string")
    quotes = spark.createDataFrame([("c", 1, "去公园"), ("c", 2, "早睡")], "conv_id string, memory_id long, quote string")
    sections = spark.createDataFrame([("s", 1, "old"), ("s", 2, "both")], "section string, ordinal int, text string")
    analyse = lambda added: spark.createDataFrame([("s", 1, "both"), ("s", 2, f"new {added.count()}")], "section string, ordinal int, text string")
    got = T.applied_increment(known, incoming, sections, ledger, quotes, analyse)
    assert [(r["seq"], r["text"]) for r in got.messages.orderBy("seq").collect()] == [(1, "周末去公园"), (2, "好"), (3, "公园取消了")]
    assert {r["memory_id"]: r["status"] for r in got.ledger.collect()} == {1: "uncertain", 2: "fact"}
    assert [r["text"] for r in got.sections.orderBy("ordinal").collect()] == ["old", "both", "new 1"]


def test_comparisons_are_blind_until_all_are_chosen(spark):
    cases = spark.createDataFrame([("c", f"x{k}") for k in range(20)], "conv_id string, id string")
    run = T.comparison(cases, 3)
    assert {r["first"] for r in run.collect()} == {"a", "b"} and sorted(map(tuple, run.collect())) == sorted(map(tuple, T.comparison(cases.repartition(5), 3).collect()))
    results = run.selectExpr("conv_id", "id", "explode(array('a', 'b')) AS side", "'r' AS reply")
    votes = spark.createDataFrame([("c", "x0", "a", 1), ("c", "x0", "b", 2), ("c", "x1", "tie", 1), ("c", "x2", "odd", 1)], "conv_id string, id string, choice string, at int")
    chosen = {r["id"]: r["side"] for r in T.choices(run, results, votes).collect()}
    second = {r["id"]: r["second"] for r in run.collect()}
    assert chosen == {"x0": second["x0"], "x1": "tie"}
    assert T.choices(run, results.where("side = 'a'"), votes).count() == 0
    assert tuple(T.verdict(run, T.choices(run, results, votes)).collect()[0])[1:3] == (20, 2)


def test_layer_texts(spark):
    df = spark.createDataFrame([("一句\n两句\n三句\n四句", "a"), ("one\ntwo\n\nthree\nfour", "b"), ("a\nb", "c"), ("混\nab\n排\nx", "d")], "t string, k string")
    got = {r["k"]: r["u"] for r in df.select("k", Y.unwrapped(df["t"]).alias("u")).collect()}
    assert got == {"a": "一句两句三句四句", "b": "one two three four", "c": "a\nb", "d": "混ab排x"}
    docs = spark.createDataFrame([("zh", "a.md", "打 13800138000"), ("zh", "none.md", " ")], "conv_id string, path string, body string")
    files = {r["path"]: r for r in Y.assembled(docs, zh(spark), 500).collect()}
    assert set(files) >= {"a.md", "README.md"} and "13800138000" not in files["a.md"]["body"] and all(r["bytes"] == len(r["body"].encode()) for r in files.values())
    assert any(p.startswith("transcript/") for p in files)


def test_sources_are_outside_the_budget_and_redaction_comes_after_it(spark):
    day = datetime(2024, 3, 1, 9)
    m = spark.createDataFrame([("c", 1, day.replace(month=2), "a", "call 13800138000", "", ""), ("c", 2, day, "a", "hi", "", ""), (None, 1, day, "a", "x", "", "")], M.SCHEMA)
    docs = spark.createDataFrame([("c", "topics.md", "mail a.b@c.org"), ("c", "none.md", None)], "conv_id string, path string, body string")
    sources = spark.createDataFrame([("c", "s.txt", "13800138000"), ("c", "big.txt", "x" * 100), ("c", "empty.txt", ""), ("c", "null.txt", None)], "conv_id string, name string, body string")
    whole = {r["month"]: r["bytes"] for r in K.months(m.where("conv_id = 'c'")).collect()}
    room = len("mail a.b@c.org") + sum(whole.values())
    get = lambda budget: {r["path"]: r for r in Y.assembled(docs, m, budget, sources=sources, source_cap=20).where("conv_id = 'c'").collect()}
    got = get(room)
    assert set(got) == {"topics.md", "transcript/2024-02.md", "transcript/2024-03.md", "source/s.txt", "README.md"}
    assert "13800138000" not in got["transcript/2024-02.md"]["body"] + got["source/s.txt"]["body"] and "big.txt（100）" in got["README.md"]["body"]
    assert all(r["bytes"] == len(r["body"].encode()) for r in got.values())
    assert set(get(room - 1)) == set(got) - {"transcript/2024-02.md"} and "2024-02" in get(room - 1)["README.md"]["body"]


def test_versions_with_repeated_paths_have_a_row_each(spark):
    from talkframe.operators import changes as C

    old = spark.createDataFrame([(2, "a", "y"), (1, "a", "x"), (3, "b", "x"), (4, "c", None), (5, "c", "z")], "n long, path string, sha256 string")
    new = spark.createDataFrame([(7, "a", "x"), (6, "a", "y"), (8, "c", "z"), (9, "d", "x"), (10, "d", "y")], "n long, path string, sha256 string")
    assert sorted(tuple(r) for r in C.version_changes(old, new, "n").collect()) == [("a", "changed"), ("b", "removed"), ("d", "added")]


def test_shared_bigrams_are_counted_by_blocks():
    from talkframe.operators import evidence as V

    rng = random.Random(4)
    forms = ["ab", "aaaa", *("".join(rng.choices("abc\u6f22\U0001f600", k=rng.randint(2, 9))) for _ in range(30))]
    lines = ["".join(rng.choices("abcd\u6f22\U0001f600", k=rng.randint(2, 12))) for _ in range(V.AT_ONCE + 40)]
    sets = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    want = [[len(sets(f) & sets(line)) for line in lines] for f in forms]
    got = [[] for _ in forms]
    for first, hits in V.shared_bigrams(forms, lines):
        assert first == len(got[0])
        for row, more in zip(got, hits.astype(int).tolist(), strict=True):
            row += more
    assert got == want


def test_shared_phrases_cut_their_grams_in_one_pass(spark):
    from talkframe.operators import mining as N

    m = zh(spark)
    found = N.shared_phrases(m, spark.createDataFrame([("zh", "\u963f\u6728", "\u5c0f\u96e8")], "conv_id string, target string, counterpart string"))
    assert str(found._jdf.queryExecution().optimizedPlan().toString()).count("Generate ") <= 5
