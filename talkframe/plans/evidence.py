"""Queries over claims, citations, specificity, memory, retrieval and privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators import evidence as V
from talkframe.operators import privacy as R
from talkframe.plans.base import cv, literal, query, sides, table, values, zh

CLAIMS = [
    ("zh", 1, "下次一定"), ("zh", 2, "2024-03-01 小雨: 今天有空吗"), ("zh", 3, "要不要去滨江公园 好啊一起去"), ("zh", 4, "报告写完了么 快要截止了"), ("zh", 5, "从来没有说过的一句话"), ("zh", 6, "早点睡，别熬夜"), ("zh", 7, "哈"), ("zh", 8, "[09:30] 阿木：别催"),
]
ITEMS = [
    ("zh", 1, "inside_jokes", "「下次一定」是固定说法", "下次一定"), ("zh", 2, "关系时间线", "2024年3月说定「一起去」公园", "一起去"), ("zh", 3, "关系时间线", "2023-07 和 5月6日 的事", "不存在的话"),
    ("zh", 4, "甜蜜瞬间", "「我想你了」很温柔体贴", "我想你了"), ("zh", 5, "一起去过的地方", "「公园门口」", "我到公园门口了"), ("zh", 6, "典型例句", "「别催 知道了」", "别催 知道了"),
]


def _claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLAIMS, "conv_id string, claim_id long, claim string")


def _items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ITEMS, "conv_id string, item_id long, section string, text string, claim string")


@query()
def v02_verified(spark, sf):
    return V.verified(_claims(spark), zh(spark))


@query()
def v03_located(spark, sf):
    return V.located(_claims(spark), zh(spark)).select("conv_id", "claim_id", "score", "seq", "speaker", "raw")


#: Folding as far as the tables need it: they have no compatibility characters.
FOLD = "lower(regexp_replace(nfc_normalize({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
CORPUS = f"""cr AS (SELECT conv_id, seq, trim(unnest(string_split(text, chr(10)))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM cv),
    cn AS (SELECT *, {FOLD.format('raw')} AS norm FROM cr), co AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq, pos) AS line_id, seq, raw, norm FROM cn WHERE length(norm) >= 2)"""
#: From the middle of each message to the middle of the next one: claims that run over lines, and half of them with a word changed.
ACROSS = "substring(text, greatest(1, length(text) - 39), 40)"


@query(f"""WITH {CORPUS}, fl AS (SELECT conv_id, string_agg(norm, '' ORDER BY line_id) AS flat FROM co GROUP BY 1),
    cs AS (SELECT conv_id, seq AS claim_id, {ACROSS} || ' ' || left(lead(text) OVER (PARTITION BY conv_id ORDER BY seq), 40) || CASE WHEN seq % 2 = 0 THEN ' qqq' ELSE '' END AS claim FROM cv),
    pt AS (SELECT *, list_filter(regexp_split_to_array(claim, {literal(L.CLAIM_BREAK)}), lambda x: x <> '') AS parts FROM cs),
    fm AS (SELECT *, list_transform(range(1, least(6, len(parts))), lambda k: {FOLD.format("array_to_string(list_slice(parts, len(parts) - k + 1, len(parts)), ' ')")}) AS tails FROM pt)
    SELECT conv_id, claim_id, contains(flat, {FOLD.format('claim')}) OR len(list_filter(tails, lambda t: length(t) >= 2 AND contains(flat, t))) > 0 AS found FROM fm JOIN fl USING (conv_id) WHERE claim IS NOT NULL""")
def v02_contained(spark, sf):
    m = cv(spark, sf)
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("seq"))
    claim = F.concat(F.expr(ACROSS), F.lit(" "), F.left(following, F.lit(40)), F.when(F.col("seq") % 2 == 0, " qqq").otherwise(""))
    claims = m.select("conv_id", F.col("seq").alias("claim_id"), claim.alias("claim")).where("claim IS NOT NULL")
    found = V.contained(claims, m, V.corpus_lines(m)).withColumn("found", F.lit(True))
    return claims.join(found, ["conv_id", "claim_id"], "left").select("conv_id", "claim_id", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"WITH {CORPUS} SELECT * FROM co")
def v01_corpus_lines(spark, sf):
    return V.corpus_lines(cv(spark, sf)).select("conv_id", "line_id", "seq", "raw", "norm")


@query()
def j04_bigram_candidates(spark, sf):
    """Every sentence of each benchmark passage against the lines of all conversations, by shared bigrams and ordered coverage: a row for each sentence, from 0."""
    m = cv(spark, sf)
    lines = V.corpus_lines(m).withColumn("line_id", F.xxhash64("conv_id", "line_id")).withColumn("conv_id", F.lit("all"))
    sentences = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "[.]")).alias("sentence", "claim")).where(X.stripped("claim") != "")
    claims = sentences.select(F.lit("all").alias("conv_id"), F.xxhash64("item_id", "sentence").alias("claim_id"), "item_id", "sentence", "claim")
    found = V.matched(claims.select("conv_id", "claim_id", "claim"), m.withColumn("conv_id", F.lit("all")), lines)
    return found.join(claims.select("claim_id", "item_id", "sentence"), "claim_id").select("conv_id", F.col("item_id").alias("claim_id"), "sentence", "score", "line_id")


@query()
def v09_citations(spark, sf):
    return V.citations(_items(spark), zh(spark))


@query()
def v05_date_checks(spark, sf):
    return V.date_checks(_items(spark), zh(spark).unionByName(zh(spark).withColumn("ts", F.expr("ts + INTERVAL 40 DAYS")).withColumn("seq", F.col("seq") + 100)))




@query("""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def j03_evidence_join(spark, sf):
    from talkframe.plans.mining import containing

    return containing(spark, sf)


@query(f"WITH {values('items', 'conv_id, item_id, section, text, claim', ITEMS)} SELECT item_id, seq FROM items JOIN zh USING (conv_id) WHERE contains(zh.text, claim)")
def j03_evidence_zh(spark, sf):
    return V.quoting(_items(spark), zh(spark)).select("item_id", "seq")


@query(f"WITH {values('items', 'conv_id, item_id, section, text, claim', ITEMS)} SELECT conv_id, item_id, bool_and(EXISTS (SELECT 1 FROM zh WHERE contains(zh.text, claim))) AS all_quoted FROM items GROUP BY 1, 2")
def j18_all_quoted(spark, sf):
    return V.all_quoted(_items(spark).select("conv_id", "item_id", "claim"), zh(spark))


@query()
def j09_counter_evidence(spark, sf):
    return V.counter_evidence(_items(spark), zh(spark), sides(spark).select("conv_id", "target"), least=2)


@query(f"WITH {values('items', 'conv_id, item_id, section, text, claim', ITEMS)}, f AS (SELECT item_id, conv_id, seq FROM items JOIN zh USING (conv_id) WHERE contains(zh.text, claim)), n AS (SELECT conv_id, seq, lag(text) OVER w AS before, lead(text) OVER w AS after FROM zh WINDOW w AS (PARTITION BY conv_id ORDER BY seq)) SELECT item_id, seq, before, after FROM f JOIN n USING (conv_id, seq)")
def j15_neighbours(spark, sf):
    return V.neighbours_of(V.quoting(_items(spark), zh(spark)).select("item_id", "conv_id", "seq"), zh(spark)).select("item_id", "seq", "before", "after")


@query()
def a22_specificity(spark, sf):
    return V.specificity(_items(spark).select("conv_id", "item_id", "text", "claim"), zh(spark), sides(spark).select("conv_id", "target"))


@query()
def q08_memory_ledger(spark, sf):
    return V.ledger(_items(spark), zh(spark))


def _status_sql(text: str) -> str:
    has = lambda words: "(" + " OR ".join(f"contains({text}, {literal(w)})" for w in words) + ")"
    return f"CASE WHEN {has(L.UNCERTAIN_WORDS)} THEN 'uncertain' WHEN {has(L.PROMISE_WORDS)} THEN 'promise' WHEN {has(L.PLAN_WORDS)} THEN 'plan' WHEN len(list_filter(regexp_extract_all({text}, {literal('([^，。！？；,!?;' + chr(10) + ']{0,8})(?:' + X.pattern_of(L.DONE_WORDS) + ')')}, 1), lambda p: NOT regexp_matches(p, '[不没未别]'))) > 0 THEN 'fact' ELSE 'mentioned' END"


@query(f"SELECT conv_id, seq, {_status_sql('text')} AS status FROM chats")
def q07_memory_status(spark, sf):
    from talkframe.plans.base import chats

    return chats(spark, sf).select("conv_id", "seq", V.memory_status(F.lit("fact"), F.col("text")).alias("status"))




@query("""WITH q AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conv_id, conv_id AS query_id, unnest(list_transform(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '[A-Za-z][A-Za-z0-9_-]{2,}'), lambda x: lower(x))) AS token FROM conversations WHERE turn = 0),
    e AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS id, length(text) + 100 AS cost, unnest(list_transform(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '[A-Za-z][A-Za-z0-9_-]{2,}'), lambda x: lower(x))) AS token FROM conversations WHERE turn > 0)
    SELECT conv_id, query_id, id, CAST(sum(length(token)) AS BIGINT) AS score FROM q JOIN e USING (conv_id, token) GROUP BY 1, 2, 3""")
def t10_retrieval_scores(spark, sf):
    c = table(spark, sf, "conversations").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", " "))
    part = lambda df: F.explode(X.tokens("text")).alias("token")
    asked = c.where("turn = 0").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("conv_id").alias("query_id"), part(c)).distinct()
    known = c.where("turn > 0").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("id"), part(c)).distinct()
    return asked.join(known, ["conv_id", "token"]).groupBy("conv_id", "query_id", "id").agg(F.sum(F.length("token")).alias("score"))


@query()
def t10_retrieval(spark, sf):
    c = table(spark, sf, "conversations")
    asked = c.where("turn = 0").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("conv_id").alias("query_id"), "text")
    entries = c.where("turn > 0").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("id"), "text")
    return V.retrieved(asked, entries, budget=2500)


def _redacted_sql(text: str) -> str:
    """Word boundaries and word characters of the table's texts; RE2's are ASCII, so the ends are spelled out."""
    for pattern, tag in L.REDACTIONS:
        text = f"regexp_replace({text}, {literal(pattern)}, {literal(tag)}, 'g')"
    return text


@query(f"SELECT doc_id, {_redacted_sql('regexp_replace(text, ' + literal('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]') + ', ' + literal('~') + ', ' + literal('g') + ')')} AS text FROM documents")
def v13_redacted(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "~").alias("text"))
    return R.redact(d)


@query("SELECT conv_id, seq, CASE WHEN regexp_matches(text, {0}) THEN text || {1} ELSE text END AS text FROM chats".format(literal("|".join(L.DEIXIS)), literal(" " + L.DEIXIS_MARK)))
def v14_deixis(spark, sf):
    from talkframe.plans.base import chats

    return chats(spark, sf).select("conv_id", "seq", X.deixis_flagged("text").alias("text"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return docs.unionByName(zh(spark).select(F.concat(F.lit("zh/"), F.col("seq").cast("string")).alias("file"), "text"))


@query()
def v15_privacy_scan(spark, sf):
    return R.scan(_files(spark, sf))


@query()
def v15_privacy_risk(spark, sf):
    return R.risk(R.scan(_files(spark, sf)))


@query(r"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS file, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
    SELECT file, line, left(regexp_extract(content, '(?:^|[^0-9])(1[3-9][0-9]{9})(?:$|[^0-9])', 1), 120) AS text FROM l WHERE regexp_matches(content, '(?:^|[^0-9])1[3-9][0-9]{9}(?:$|[^0-9])')""")
def v15_phones(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return R.scan(docs).where("category = 'phone'").select("file", "line", "text")


@query()
def v16_confirmations(spark, sf):
    items = R.scan(_files(spark, sf))
    confirmed = items.where("category = 'email'").select("id", F.lit("f1").alias("fingerprint"))
    return R.with_confirmations(items, confirmed, "f1").groupBy("category").agg(F.count_if("confirmed").alias("confirmed"), F.count("*").alias("items"))


@query("SELECT doc_id, q AS quote FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[「『“\"]([^「」『』“”\"]{2,120})[」』”\"]', 1)) AS q FROM documents)")
def x07_quotes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(X.quotes("text")).alias("quote"))


RAW_TAGS = r"(?is)<(?:script|style)\b[^>]*>(.*?)</(?:script|style)\s*>"
BLOCK_TAG = "(?i)</?(?:" + "|".join(sorted(L.BLOCK_TAGS)) + r")(?:\s[^>]*)?>"
ENTITIES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def _html_sql() -> str:
    """Pages' text: markup of scripts and styles goes first, what they hold is marked so that it isn't taken for tags."""
    t = f"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"  # noqa: F541
    t = f"regexp_replace({t}, {literal(RAW_TAGS)}, {literal(chr(1) + chr(92) + '1' + chr(2))}, 'g')"
    inside = "(?s)" + chr(1) + "[^" + chr(2) + "]*" + chr(2)
    held = f"regexp_extract_all({t}, {literal(inside)})"
    pieces = f"list_zip(string_split_regex({t}, {literal(inside)}), {held})"
    plain = f"regexp_replace(regexp_replace(x[1], {literal(BLOCK_TAG)}, chr(10), 'g'), '<[^>]*>', '', 'g')"
    for k, v in ENTITIES.items():
        plain = f"replace({plain}, {literal(k)}, {literal(v)})"
    out = f"array_to_string(list_transform({pieces}, lambda x: {plain} || coalesce(replace(replace(x[2], chr(1), ''), chr(2), ''), '')), '')"
    return f"regexp_replace(regexp_replace({out}, '[ ' || chr(9) || ']+', ' ', 'g'), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT page_id, {_html_sql()} AS text FROM pages")
def s11_html_text(spark, sf):
    from talkframe.functions.udfs import html_to_text

    return table(spark, sf, "pages").select("page_id", html_to_text("html").alias("text"))


@query(f"SELECT doc_id, sha256({FOLD.format('text')}) AS fold FROM documents")
def p02_folded(spark, sf):
    from talkframe.functions.udfs import nfkc_fold

    return table(spark, sf, "documents").select("doc_id", F.sha2(nfkc_fold("text").cast("binary"), 256).alias("fold"))


@query()
def a29_findings_summary(spark, sf):
    return V.findings_summary(V.verified(_claims(spark), zh(spark)))
