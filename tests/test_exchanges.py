import random
from datetime import datetime, timedelta

import pytest

from talkframe.functions import lexicon as L
from talkframe.operators import changes as C
from talkframe.operators import evidence as V
from talkframe.operators import exchanges as E
from talkframe.operators import messages as M
from talkframe.operators import mining as N
from talkframe.operators import privacy as R
from talkframe.plans.base import sides, zh

T0 = datetime(2024, 1, 1, 12)


def chat(spark, rows):
    """rows: (minutes, speaker, text[, source_id[, reply_to]])."""
    return spark.createDataFrame([("c", i, None if r[0] is None else T0 + timedelta(minutes=r[0]), r[1], r[2], r[3] if len(r) > 3 else "", r[4] if len(r) > 4 else "") for i, r in enumerate(rows, 1)], M.SCHEMA)


def ab(spark):
    return spark.createDataFrame([("c", "b", "a")], "conv_id string, target string, counterpart string")


def test_adjacent_pairs_respect_boundaries(spark):
    rows = [
        (0, "a", "one"), (1, "a", "[图片]"), (2, "b", "two"), (3, "b", "three"), (4, "a", "x"), (5, "c", "between"), (6, "b", "y"), (100, "a", "late"), (131, "b", "next session"),
        (140, "a", "[图片][语音]"), (141, "b", "only media before"), (142, "a", "1"), (142, "a", "2"), (142, "a", "3"), (142, "a", "4"), (143, "b", "four lines before"), (150, "a", "q"), (151, "b", "[回复消息: x] r"), (152, "a", "k" * 81), (153, "b", "long"),
    ]
    got = E.adjacent(chat(spark, rows), ab(spark)).collect()
    assert [(r["incoming"], r["reply"], r["incoming_messages"], r["reply_messages"]) for r in got] == [(["one"], ["two", "three"], [1], [3, 4])]


def test_explicit_replies(spark):
    rows = [
        (0, "a", "q1", "m1"), (1, "c", "noise", "m2"), (2, "b", "r1", "m3", "m1"), (3, "b", "more"), (90, "b", "too late"), (100, "a", "dup", "d"), (100, "a", "dup2", "d"), (101, "b", "to dup", "", "d"),
        (102, "b", "forward", "", "f"), (103, "a", "later", "f"), (104, "a", "same", "s"), (105, "a", "self", "", "s"), (106, "a", "q2", "m9"), (107, "b", "1", "", "m9"), (107, "b", "2"), (107, "b", "3"), (107, "b", "4"), (200, "b", "missing", "", "nope"),
    ]
    got = E.explicit(chat(spark, rows), ab(spark)).collect()
    assert [(r["incoming"], r["reply"], r["incoming_messages"], r["reply_messages"]) for r in got] == [(["q1"], ["r1", "more"], [1], [3, 4])]


def test_situations_take_the_first_rule(spark):
    rows = [(["谢谢 快写报告"], ["别催"]), (["谢谢你"], ["没事"]), (["hello"], ["hi"]), (["[引用消息: x] 谢谢"], ["没事"])]
    df = spark.createDataFrame([(i, r, 0, [i], a) for i, (a, r) in enumerate(rows)], "id int, reply array<string>, session_id int, reply_messages array<int>, incoming array<string>")
    assert [r["label"] for r in E.classified(df).orderBy("id").collect()] == ["被催或被提醒", "对方表达感谢", L.EVERYDAY, L.EVERYDAY]


def plain_choice(rows, limit):
    """Places of picks, valuing all rows each time."""
    rows = [(k, r) for k, r in enumerate(rows) if (r["incoming"], r["reply"]) not in [(x["incoming"], x["reply"]) for x in rows[:k]]]
    picked = []
    for _ in range(min(limit, len(rows))):
        used = {c for k in picked for c in dict(rows)[k]["reply"][0]}
        worth = {
            k: 3 * bool(r["action"]) + 2 * len(set(r["reply"][0]) - used) / max(1, len(set(r["reply"][0]))) + min(len(r["reply"][0]), 30) / 30
            - 3 * sum(dict(rows)[p]["label"] == r["label"] for p in picked) - 2 * sum(dict(rows)[p]["session_id"] == r["session_id"] for p in picked)
            for k, r in rows if k not in picked
        }
        picked.append(min(worth, key=lambda k: (-worth[k], k)))
    return picked


def test_selected_equals_a_plain_choice(spark):
    rng = random.Random(2)
    row = lambda s, said, label="x", action="do": {"incoming": ["i" + said], "reply": [said], "session_id": s, "label": label, "action": action}
    rows = [row(1, "abc"), row(1, "abc"), row(1, "abd"), row(2, "xyz"), row(3, "q", "y", "")]
    rows += [row(rng.randrange(6), "".join(rng.choice("abcdefgh漢字") for _ in range(rng.randrange(1, 40))), rng.choice("xyz"), rng.choice(["", "do"])) for _ in range(40)]
    schema = "conv_id string, incoming array<string>, reply array<string>, session_id long, label string, action string, reply_messages array<long>"
    df = spark.createDataFrame([("c", r["incoming"], r["reply"], r["session_id"], r["label"], r["action"], [k]) for k, r in enumerate(rows)], schema)
    for limit in (0, 1, 5, 8):
        got = E.selected(df.repartition(3), limit).orderBy("rank").collect()
        assert [r["reply_messages"][0] for r in got] == plain_choice(rows, limit)


def test_scenarios_and_routes(spark):
    pairs = E.classified(E.exchanges(zh(spark), sides(spark)))
    routes = E.scenarios(pairs)
    by = {r["label"]: r for r in routes.collect()}
    assert by["对方表达感谢"]["confidence"] == "repeated_observation" and by["对方表达感谢"]["id"] == "thanks-reciprocity"
    inputs = spark.createDataFrame([("zh", 1, "谢谢你帮大忙"), ("zh", 2, "我真的难受 谢谢"), ("zh", 3, "xyz")], "conv_id string, id long, text string")
    got = {r["id"]: r["label"] for r in E.routed(inputs, routes).collect()}
    assert got == {1: "对方表达感谢"}


def test_pack_first_fit_decreasing():
    units = ["a" * 19, "b" * 19, "c" * 200, "d" * 19]
    packed, left = E.pack(units, 45, 2)
    assert left == 1 and packed == ["a" * 19 + "\n\n---\n\n" + "b" * 19, "d" * 19]
    assert E.pack(units, 0, 2) == ([], 4) and E.pack([], 5, 5) == ([], 0) and E.pack(["x"], 5, 0) == ([], 1)


def test_multiset_additions(spark):
    known = chat(spark, [(0, "a", "x"), (0, "a", "x")])
    incoming = chat(spark, [(0, "a", "x"), (0, "a", "x"), (0, "a", "x"), (1, "b", "没有取消 周末去公园")])
    added = C.additions(known, incoming)
    assert [(r["seq"], r["message"]) for r in added.orderBy("seq").collect()] == [(3, 1), (4, 2)]
    facts = spark.createDataFrame([("c", 1, "plan", "周末见"), ("c", 2, "joke", "周末见"), ("c", 3, "fact", "没有")], "conv_id string, memory_id long, status string, quote string")
    assert [(r["memory_id"], r["message"]) for r in C.conflicts(added, facts).collect()] == [(1, 2)]


@pytest.mark.parametrize("percent,tested", [(0, 0), (1, 1), (25, 2), (40, 3)])
def test_holdout_takes_whole_sessions(spark, percent, tested):
    m = chat(spark, [(100 * k + j, "ab"[j], f"t{k}{j}") for k in range(8) for j in range(2)])
    got = C.holdout(m, percent).groupBy("session_id").agg({"test": "max", "seq": "count"}).collect()
    assert sum(r["max(test)"] for r in got) == tested and all(r["count(seq)"] == 2 for r in got)
    assert C.holdout(chat(spark, [(0, "a", "x"), (100, "a", "y")]), 40).where("test").count() == 0
    with pytest.raises(ValueError):
        C.holdout(m, 41)


def test_claims(spark):
    rows = [("c", 1, "早点睡吧"), ("c", 2, "2024-01-01 a: 早点睡吧"), ("c", 3, "你好世界再见"), ("c", 4, "今天天气真的很不错呀"), ("c", 5, "毫无关系的东西")]
    m = chat(spark, [(0, "a", "早点睡吧 明天见"), (1, "b", "你好世界"), (2, "a", "再见"), (3, "b", "今天的天气真的不错呀")])
    got = {r["claim_id"]: r["status"] for r in V.verified(spark.createDataFrame(rows, "conv_id string, claim_id long, claim string"), m).collect()}
    assert got == {1: "verified", 2: "verified", 3: "verified", 4: "fuzzy", 5: "unverified"}


def test_redaction_order(spark):
    rows = ["call 13800138000 now", "id 11010520001231002X.", "card 6222021234567890123", "a.b+c@d-e.org", "江苏省南京市鼓楼区", "中文110105194912310021中文"]
    got = [r["text"] for r in R.redact(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")).orderBy("i").collect()]
    assert got[0] == "call [手机号] now" and got[1] == "id [身份证]." and got[3] == "[邮箱]" and got[4] == "[详细地址]"
    assert got[2] in ("card [卡号]", "card 6222021234567890123") and got[5].startswith("中文1")


def test_privacy_scan_has_one_item_a_rule_and_line(spark):
    df = spark.createDataFrame([("f", "13800138000 13900139000\na@b.cc\nnothing\n咱们的学校")], "file string, text string")
    got = sorted((r["line"], r["category"], r["severity"]) for r in R.scan(df).collect())
    assert got == [(1, "phone", "high"), (2, "email", "high"), (4, "location", "medium"), (4, "private_deixis", "medium")]
    assert R.risk(R.scan(df)).collect()[0]["risk"] == "high"


def test_memory_status(spark):
    rows = [("fact", "可能去"), ("fact", "我答应你"), ("fact", "下次去"), ("fact", "没去了"), ("fact", "昨天去了"), ("joke", "一定"), ("fact", "公园")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, text string")
    got = [r["s"] for r in df.select("i", V.memory_status(df["kind"], df["text"]).alias("s")).orderBy("i").collect()]
    assert got == ["uncertain", "promise", "plan", "mentioned", "fact", "joke", "mentioned"]


def test_topics_keep_the_longest(spark):
    m = chat(spark, [(i, "a", "周末去公园") for i in range(12)])
    got = [(r["gram"], r["n"]) for r in N.topics(m).collect()]
    assert got == [("周末去公园", 12)]
