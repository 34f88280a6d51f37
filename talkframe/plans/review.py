"""Queries over evaluation, feedback, questions, decisions, the quality gate and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators import evidence as V
from talkframe.operators import exchanges as E
from talkframe.operators import packs as K
from talkframe.operators import review as R
from talkframe.plans.base import chats, ev, literal, query, sides, table, values, zh
from talkframe.plans.evidence import ITEMS, _items
from talkframe.plans.exchanges import zh_pairs
from talkframe.plans.sessions import KEY

FEEDBACK = [
    ("zh", 1, "谢谢你", "像本人", "", ""), ("zh", 2, "谢谢你", "太客气", "thanks-reciprocity", "短一点"), ("zh", 3, "快写报告", "答非所问", "", ""), ("zh", 4, "在吗", "奇怪", "", "打我 13800138000"), ("zh", 5, "谢谢你", "太客气", "thanks-reciprocity", "短一点"),
]
GATE = [
    ("zh", 1, "人物特点", "幽默风趣"), ("zh", 2, "人物特点", "爱说「下次一定」"), ("zh", 3, "人物特点", "爱说「没说过」"), ("zh", 4, "硬规则", "隔 3 分钟回"), ("zh", 5, "硬规则", "从不说肉麻的话"), ("zh", 6, "硬规则", "短句"),
    ("zh", 7, "情境策略", "对方：「恭喜你通过了」 → 我：「我也没想到~」"), ("zh", 8, "情境策略", "对方：「恭喜你通过了」 → 我：「谢谢」"), ("zh", 9, "口头禅", "「下次一定」"), ("zh", 10, "典型例句", "「老地方」"), ("zh", 11, "典型例句", "「没说过」"), ("zh", 12, "说话风格", "消息长度：中位 5 字"), ("zh", 13, "硬规则", "短句"),
]


def _feedback(spark):
    return spark.createDataFrame(FEEDBACK, "conv_id string, seq long, user string, label string, scenario_id string, note string")


def _target(spark):
    return sides(spark).select("conv_id", "target")


def _gate(spark):
    return spark.createDataFrame(GATE, "conv_id string, item_id long, section string, text string")


@query()
def q09_cases(spark, sf):
    return R.cases(E.scenarios(zh_pairs(spark)))


@query()
def q09_checks(spark, sf):
    routes = E.scenarios(zh_pairs(spark))
    cases = R.cases(routes)
    replies = cases.select("conv_id", "id", F.when(F.col("n") == 1, "您好，不客气").when(F.col("n") == 2, F.get("allowed_quotes", F.lit(0))).otherwise("").alias("reply")).where("n <> 3")
    return R.checked(cases, replies, routes)


@query()
def q10_case_pool(spark, sf):
    return R.pooled_cases(R.cases(E.scenarios(zh_pairs(spark))), _feedback(spark))


@query()
def a25_check_totals(spark, sf):
    return R.totals(q09_checks(spark, sf))


@query(f"""WITH {values('fb', 'conv_id, seq, user_, label, scenario_id, note', FEEDBACK)} SELECT conv_id, CASE WHEN label IN ({', '.join(map(literal, L.FEEDBACK_LABELS))}) THEN label ELSE '其他' END AS key, count(*) AS n, 'label' AS kind FROM fb GROUP BY 1, 2
    UNION ALL SELECT conv_id, coalesce(nullif(scenario_id, ''), '未分类'), count(*), 'failed' FROM fb WHERE label IN ({', '.join(map(literal, L.CORRECTIONS))}) GROUP BY 1, 2""")
def a24_feedback_summary(spark, sf):
    return R.feedback_summary(_feedback(spark))


@query()
def q15_feedback_rules(spark, sf):
    return R.feedback_rules(_feedback(spark))


@query()
def v12_questions(spark, sf):
    items = V.specificity(_items(spark).select("conv_id", "item_id", "text", "claim"), zh(spark), _target(spark))
    cover = E.coverage(zh_pairs(spark), E.scenarios(zh_pairs(spark)), zh(spark), sides(spark))
    return R.questions(items, cover, V.ledger(_items(spark), zh(spark)))


@query()
def v17_answers(spark, sf):
    asked = v12_questions(spark, sf)
    answers = spark.createDataFrame([("specificity-3", "confirmed", "打 13800138000", "f"), ("specificity-4", "confirmed", "", "f"), ("coverage-对方要求正经一点", "rejected", "", "old")], "id string, status string, note string, fingerprint string")
    return R.answered(asked, answers, "f")


@query("SELECT doc_id, substr(sha256(lang || chr(10) || regexp_replace(text, '\\s+', '', 'g')), 1, 24) AS id FROM documents WHERE NOT regexp_matches(text, '[「『“\"][^「」『』“”\"]{2,120}[」』”\"]')")
def x11_claim_identity(spark, sf):
    d = table(spark, sf, "documents").where(F.size(X.quotes("text")) == 0)
    return d.select("doc_id", R.claim_identity(F.col("lang"), F.col("text")).alias("id"))


@query()
def v18_decisions(spark, sf):
    items = _gate(spark).where("section = '人物特点'").select("conv_id", F.lit("阿木").alias("target"), F.col("item_id").alias("ordinal"), "text")
    ids = {r["ordinal"]: r["id"] for r in items.select("ordinal", R.claim_identity(F.col("target"), F.col("text")).alias("id")).collect()}  # the fixture's three items
    decisions = [(ids[1], "rejected", "", ""), (ids[2], "rewritten", "私聊", "常说下次"), (ids[3], "kept", "", "")]
    return R.decided(items, spark.createDataFrame(decisions, "id string, status string, scope string, replacement string"))


@query()
def x08_quoted_pairs(spark, sf):
    return _gate(spark).select("item_id", F.explode(R.quoted_pairs(F.col("text"))).alias("p")).select("item_id", F.array_join("p.incoming", "|").alias("incoming"), F.array_join("p.reply", "|").alias("reply"))


@query()
def v11_quality_gate(spark, sf):
    return R.gated(_gate(spark), zh(spark), _target(spark), E.exchanges(zh(spark), sides(spark)))


@query(f"""WITH {values('items', 'conv_id, item_id, section, text', GATE)}, f AS (SELECT conv_id, section, text, min(item_id) AS item_id FROM items GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, section ORDER BY item_id) AS ordinal FROM f) SELECT * FROM n WHERE section <> '人物特点' OR ordinal <= 2""")
def v11_caps(spark, sf):
    return R.capped(_gate(spark), {"人物特点": 2})


@query()
def v07_findings(spark, sf):
    return R.evidence_checks(_items(spark).drop("claim").unionAll(spark.createDataFrame([("zh", 9, "依据", "爱约饭 ← 小雨: 今天有空吗")], "conv_id string, item_id long, section string, text string")), zh(spark))


@query()
def v07_applied(spark, sf):
    items = _items(spark).drop("claim")
    return R.applied(items, R.evidence_checks(items, zh(spark)))


@query("""WITH l AS (SELECT conv_id, coalesce(strftime(ts, '%Y-%m'), '未标时间') AS month, coalesce(strftime(ts, '%Y-%m-%d %H:%M'), '（无时间）') || ' ' || speaker || '：' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM chats)
    SELECT conv_id, month, count(*) AS messages, CAST(sum(strlen(line) + 1) + strlen('# ' || month || '（' || count(*) || ' 条）') + 2 AS BIGINT) AS bytes FROM l GROUP BY 1, 2""")
def k02_months(spark, sf):
    return K.months(chats(spark, sf))


@query()
def k01_transcript_budget(spark, sf):
    return K.transcript(zh(spark).unionByName(ev(spark, sf)), 2000)


@query()
def t02_samples(spark, sf):
    return K.samples(zh(spark), _target(spark), 600, 300)


@query(f"WITH k AS (SELECT conv_id, session_id, sha256(string_agg({KEY}, chr(10) ORDER BY seq)) AS h FROM ev_s GROUP BY 1, 2) SELECT conv_id, session_id, substr(h, 1, 16) AS id FROM k")
def l01_session_fingerprints(spark, sf):
    from talkframe.operators.sessions import with_sessions

    s = with_sessions(ev(spark, sf)).withColumn("key", X.content_key("ts", "speaker", "text"))
    by = s.groupBy("conv_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "key"))).alias("k"))
    return by.select("conv_id", "session_id", F.left(F.sha2(F.array_join("k.key", "\n").cast("binary"), 256), F.lit(16)).alias("id"))


@query(f"SELECT item_id, len(string_split_regex(text, {literal(L.CITE_ARROW)})) AS parts FROM ({'SELECT * FROM (VALUES ' + ', '.join('(' + str(i[1]) + ', ' + literal(i[3] + ' ← x') + ')' for i in ITEMS) + ') AS t(item_id, text)'})")
def x09_citation_split(spark, sf):
    return _items(spark).select("item_id", F.size(F.split(F.concat("text", F.lit(" ← x")), L.CITE_ARROW)).alias("parts"))
