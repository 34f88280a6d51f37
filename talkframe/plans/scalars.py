"""Queries over text, number and collection functions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import tables
from talkframe.functions import text as X
from talkframe.plans.base import chats, cv, dv, literal, query, table, values, zh
from talkframe.sources import files as S
from talkframe.sources import times

QUEUE = "消息记录\n================\n2024-03-01 09:00:00 小雨(10001)\n在干嘛\n\n吃饭了吗\n2024-03-01 09:01 阿木<a@b.c>\n刚到\n[图片:B572F40F.jpg]\n/睁眼/微笑\n对方已接收文件「报告.docx」\n"
WHATSAPP = "[01/03/2024, 09:00:05] Ann: hello\nmore text\n[13/3/24, 21:15] Bob: hi there\n3/14/2024, 9:05 PM - Ann: late\n2024-03-15 08:00 - Bob: iso\n"
GENERIC = "[2024-03-01 09:00] 小雨: 早\n接着说\n阿木：来了\n2024年3月2日 10:05 小雨：好\n3-04 11:00 阿木: 无年份\n----\n很长的一行没有冒号\n"


def texts(spark, name: str, text: str):
    return spark.createDataFrame([(name, text)], "file string, text string")


@query()
def s06_queue_export(spark, sf):
    return S.parse_queue(texts(spark, "queue.txt", QUEUE)).withColumn("text", X.normalized("text"))


@query()
def s07_whatsapp(spark, sf):
    return S.parse_whatsapp(texts(spark, "wa.txt", WHATSAPP))


@query()
def s08_generic_text(spark, sf):
    return S.parse_generic(texts(spark, "chat.txt", GENERIC), default_year=2024)


@query()
def s14_whatsapp_sniff(spark, sf):
    return S.is_whatsapp(texts(spark, "wa.txt", WHATSAPP).unionAll(texts(spark, "chat.txt", GENERIC)))


STAMPS = [(1, "2024-03-01 09:00:05 x"), (2, "2024/3/1 9:05"), (3, "2024年3月1日 09:05:61"), (4, "3-1 09:05 y"), (5, "1969-01-01 00:00"), (6, "2024-13-01 00:00"), (7, "no time"), (8, "2024-03-01T23:59")]


@query(f"""WITH {values('st', 'id, text', STAMPS)}, g AS (SELECT id, regexp_extract(text, '^(\\d{{4}})[-/.](\\d{{1,2}})[-/.](\\d{{1,2}})[ T](\\d{{1,2}}):(\\d{{2}})(?::(\\d{{2}}))?', ['y', 'm', 'd', 'h', 'i', 's']) AS a, regexp_extract(text, '^(\\d{{4}})年(\\d{{1,2}})月(\\d{{1,2}})日\\s*(\\d{{1,2}}):(\\d{{2}})(?::(\\d{{2}}))?', ['y', 'm', 'd', 'h', 'i', 's']) AS b, regexp_extract(text, '^(\\d{{1,2}})[-/.](\\d{{1,2}})[ T](\\d{{1,2}}):(\\d{{2}})', ['m', 'd', 'h', 'i']) AS c FROM st)
    SELECT id, coalesce(CASE WHEN a.y BETWEEN '1970' AND '2100' THEN try_strptime(a.y || '-' || a.m || '-' || a.d || ' ' || a.h || ':' || a.i || ':' || CASE WHEN a.s = '' THEN '00' WHEN a.s > '59' THEN '59' ELSE a.s END, '%Y-%m-%d %H:%M:%S') END,
        CASE WHEN b.y BETWEEN '1970' AND '2100' THEN try_strptime(b.y || '-' || b.m || '-' || b.d || ' ' || b.h || ':' || b.i || ':' || CASE WHEN b.s = '' THEN '00' WHEN b.s > '59' THEN '59' ELSE b.s END, '%Y-%m-%d %H:%M:%S') END,
        CASE WHEN c.m <> '' THEN try_strptime('2024-' || c.m || '-' || c.d || ' ' || c.h || ':' || c.i, '%Y-%m-%d %H:%M') END) AS ts FROM g""")
def s13_times(spark, sf):
    df = spark.createDataFrame(STAMPS, "id long, text string")
    return df.select("id", times.prefix_time(F.col("text"), 2024)[0].alias("ts"))


MEDIA = [(1, "[图片:ab.jpg] hi"), (2, "[图片] local_id=18750"), (3, "/睁眼/微笑"), (4, "对方已接收文件「a.docx」"), (5, "plain /path"), (6, "[语音：3秒][视频]"), (7, "")]


@query(f"""WITH {values('mt', 'id, text', MEDIA)}, a AS (SELECT id, regexp_replace(regexp_replace(text, '\\s+local_id=\\d+\\s*$', ''), '\\[({L.MEDIA_KINDS})\\s*[:：][^\\[\\]]{{0,240}}\\]', '[\\1]', 'g') AS t FROM mt)
    SELECT id, CASE WHEN regexp_matches(trim(t), '^(?:对方|我|你)?已?(?:接收|发送)文件[「『"].*[」』"]$') THEN '[文件]' WHEN regexp_matches(t, '(?:/[^\\s/:：，。！？、]{{1,12}})+') AND trim(regexp_replace(t, '(?:/[^\\s/:：，。！？、]{{1,12}})+', '', 'g')) = '' THEN '[表情]' ELSE t END AS text FROM a""")
def p01_normalized(spark, sf):
    return spark.createDataFrame(MEDIA, "id long, text string").select("id", X.normalized("text").alias("text"))


@query("SELECT conv_id, seq, regexp_full_match(text, '[一-鿿]*') AS cjk, len(list_distinct(string_split(text, ''))) AS kinds FROM zh")
def p08_cjk(spark, sf):
    return zh(spark).select("conv_id", "seq", X.is_cjk("text").alias("cjk"), F.size(F.array_distinct(F.split("text", ""))).alias("kinds"))


@query(f"SELECT doc_id, regexp_matches(text, {literal(L.GENERIC_CLAIM)}) AS generic, regexp_matches(text, '(?i)always|never|the') AS absolute FROM documents")
def p14_claim_kinds(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").rlike(L.GENERIC_CLAIM).alias("generic"), F.col("text").rlike("(?i)always|never|the").alias("absolute"))


@query("SELECT conv_id, seq, CAST(len(list_distinct(list_transform(range(1, length(text)), lambda i: substr(text, i, 2)))) AS INTEGER) AS bigrams FROM cv WHERE length(text) >= 2")
def x02_bigrams(spark, sf):
    return cv(spark, sf).where(F.length("text") >= 2).select("conv_id", "seq", F.size(X.bigrams("text")).alias("bigrams"))


@query("SELECT conv_id, seq, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 34 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 34) || '…' END AS short FROM cv")
def x06_squeezed(spark, sf):
    return cv(spark, sf).select("conv_id", "seq", X.squeezed("text").alias("text"), X.shortened("text").alias("short"))


@query("""SELECT event_id, CASE WHEN v <= 0 THEN '—' WHEN v < 1 THEN '不到 1 分钟' WHEN v < 60 THEN 'm' WHEN v < 1440 THEN 'h' ELSE 'd' END AS kind FROM (SELECT event_id, value * 20 AS v FROM events)""")
def x14_durations(spark, sf):
    t = X.minutes_text(F.col("value") * 20)
    kind = F.when(t.endswith("不到 1 分钟"), t).when(t.endswith(" 分钟"), "m").when(t.endswith(" 小时"), "h").when(t.endswith(" 天"), "d").otherwise(t)
    return table(spark, sf, "events").select("event_id", kind.alias("kind"))


@query("SELECT conv_id, seq, split_part(text, ': ', 1) AS head, CASE WHEN contains(text, ': ') THEN substr(text, strpos(text, ': ') + 2) ELSE '' END AS tail FROM (SELECT conv_id, seq, replace(replace(text, '{', ''), '}', '') AS text FROM ev)")
def x09_split_once(spark, sf):
    from talkframe.plans.base import ev

    parts = F.split(F.translate("text", "{}", ""), ": ", 2)
    return ev(spark, sf).select("conv_id", "seq", parts[0].alias("head"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("tail"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def c03_json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("SELECT conv_id, list_sort(list_distinct(list(speaker))) [1] AS first_speaker, len(list_distinct(list(speaker))) AS speakers FROM chats GROUP BY conv_id")
def c01_arrays(spark, sf):
    return chats(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_set("speaker")).alias("s")).select("conv_id", F.get("s", F.lit(0)).alias("first_speaker"), F.size("s").alias("speakers"))


@query("SELECT lang, round(sqrt(avg(n_chars)), 6) AS root, median(n_chars) AS med, greatest(0, least(100, count(*) - 100)) AS clamped FROM documents GROUP BY lang")
def n01_numbers(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.sqrt(F.avg("n_chars")), 6).alias("root"), F.median("n_chars").alias("med"), F.greatest(F.lit(0), F.least(F.lit(100), F.count("*") - 100)).alias("clamped"))


@query("SELECT event_id, round_even(value, 1) AS rounded FROM events")
def n02_half_even(spark, sf):
    return table(spark, sf, "events").select("event_id", F.bround("value", 1).alias("rounded"))


@query("""SELECT strftime(ts, '%Y-%m') AS month, count(*) AS messages, CAST(sum(strlen(strftime(ts, '%Y-%m-%d %H:%M') || ' ' || speaker || '：' || regexp_replace(text, '\\s+', ' ', 'g'))) AS BIGINT) AS bytes FROM ev GROUP BY 1""")
def k01_transcript_months(spark, sf):
    from talkframe.plans.base import ev

    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" "), F.col("speaker"), F.lit("："), F.regexp_replace("text", r"\s+", " "))
    return ev(spark, sf).groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("messages"), F.sum(F.octet_length(line)).alias("bytes"))


@query("SELECT source AS section, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def a28_rollup(spark, sf):
    return dv(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "n_chars"), "seq").rollup(F.col("conv_id").alias("section"), F.col("speaker").alias("lang")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1) ORDER BY page_id) AS n FROM pages")
def s17_page_hosts(spark, sf):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    p = table(spark, sf, "pages").select("page_id", host.alias("host"))
    return p.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("page_id")))


@query("""SELECT role, substr(text, p, n) AS gram, count(*) AS times, CAST(min(p) AS INTEGER) AS first_at
    FROM (SELECT role, text, n, unnest(range(1, length(text) - n + 2)) AS p FROM conversations, (VALUES (2), (3)) AS s(n)) GROUP BY 1, 2""")
def x01_ngram_table(spark, sf):
    """N-grams by role, with the first place that any message has them at, through the table function in SQL."""
    tables.register(spark)
    said = table(spark, sf, "conversations")
    return spark.sql("SELECT c.role, g.gram, count(*) AS times, min(g.at) AS first_at FROM {said} AS c, LATERAL ngrams(c.text, 2, 3) AS g GROUP BY c.role, g.gram", said=said)
