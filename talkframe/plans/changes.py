"""Queries over incremental merges, hold-outs, versions and unions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.operators import changes as C
from talkframe.operators.messages import message_at
from talkframe.plans.base import chats, cv, ev, query, table, zh
from talkframe.plans.sessions import KEY

KNOWN, INCOMING = "(SELECT * FROM ev WHERE seq % 3 <> 0)", "(SELECT * FROM ev WHERE seq % 2 = 0 OR seq % 3 = 0 UNION ALL SELECT * REPLACE (seq + 1000000 AS seq) FROM ev WHERE seq % 5 = 0)"


def _known(spark, sf):
    return ev(spark, sf).where("seq % 3 <> 0")


def _incoming(spark, sf):
    m = ev(spark, sf)
    return m.where("seq % 2 = 0 OR seq % 3 = 0").unionByName(m.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 1000000))


@query(f"""WITH k AS (SELECT conv_id, {KEY} AS key, count(*) AS had FROM {KNOWN} GROUP BY 1, 2), i AS (SELECT conv_id, seq, {KEY} AS key FROM {INCOMING}), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY seq) AS copy FROM i)
    SELECT n.conv_id, seq, n.key, row_number() OVER (PARTITION BY n.conv_id ORDER BY seq) AS message FROM n LEFT JOIN k ON k.conv_id = n.conv_id AND k.key = n.key WHERE copy > coalesce(had, 0)""")
def j06_additions(spark, sf):
    return C.additions(_known(spark, sf), _incoming(spark, sf)).select("conv_id", "seq", "key", "message")


@query("SELECT conv_id, text FROM (SELECT conv_id, text FROM ev WHERE seq % 2 = 0 EXCEPT ALL SELECT conv_id, text FROM ev WHERE seq % 3 = 0)")
def u04_multiset_difference(spark, sf):
    m = ev(spark, sf)
    return m.where("seq % 2 = 0").select("conv_id", "text").exceptAll(m.where("seq % 3 = 0").select("conv_id", "text"))


MARKS = ("not", "pas", "nicht")


@query("""WITH f AS (SELECT DISTINCT conv_id, seq AS memory_id, substr(text, pos, 2) AS gram FROM (SELECT conv_id, seq, text, unnest(range(1, length(text))) AS pos FROM cv WHERE seq <= 2) WHERE regexp_full_match(substr(text, pos, 2), '[a-z]{2}')),
    a AS (SELECT conv_id, seq, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS message, text FROM cv WHERE seq > 2)
    SELECT DISTINCT a.conv_id, memory_id, message, text AS quote FROM a JOIN f ON f.conv_id = a.conv_id AND contains(a.text, gram) WHERE contains(text, 'not') OR contains(text, 'pas') OR contains(text, 'nicht')""")
def j07_memory_conflicts(spark, sf):
    m = cv(spark, sf)
    facts = m.where("seq <= 2").select("conv_id", F.col("seq").alias("memory_id"), F.lit("fact").alias("status"), F.col("text").alias("quote"))
    return C.conflicts(C.additions(m.where("seq <= 2"), m.where("seq > 2")), facts, marks=MARKS, cjk=False)


@query()
def r01_detect_zh(spark, sf):
    m = zh(spark)
    facts = spark.createDataFrame([("zh", 1, "plan", "我没想到"), ("zh", 2, "joke", "我没想到"), ("zh", 3, "fact", "去滨江公园")], "conv_id string, memory_id long, status string, quote string")
    return C.conflicts(C.additions(m.where("seq <= 20"), m), facts)


@query(f"""WITH k AS (SELECT conv_id, session_id, sha256(string_agg({KEY}, chr(10) ORDER BY seq)) AS h FROM ev_s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY h, session_id) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM k)
    SELECT conv_id, seq, session_id, place <= CASE WHEN n >= 3 THEN least(n - 2, greatest(1, n * 20 // 100)) ELSE 0 END AS test FROM ev_s JOIN r USING (conv_id, session_id)""")
def q12_holdout(spark, sf):
    return C.holdout(ev(spark, sf), 20).select("conv_id", "seq", "session_id", "test")


@query("""SELECT doc_id AS id FROM documents WHERE NOT EXISTS (SELECT 1 FROM benchmark WHERE contains(documents.text, benchmark.text))""")
def j13_training_feedback(spark, sf):
    feedback = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.training_feedback(feedback, table(spark, sf, "benchmark").select("text"), least=24).select("id")


@query("""WITH a AS (SELECT url AS path, any_value(sha256(html)) AS h FROM pages WHERE page_id % 3 <> 0 GROUP BY 1), b AS (SELECT url AS path, any_value(CASE WHEN page_id % 4 = 0 THEN 'x' ELSE sha256(html) END) AS h FROM pages WHERE page_id % 5 <> 0 GROUP BY 1)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS NULL OR b.h IS NULL OR a.h <> b.h""")
def j14_version_changes(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))
    new = p.where("page_id % 5 <> 0").withColumn("sha256", F.when(F.col("page_id") % 4 == 0, "x").otherwise(F.col("sha256")))
    return C.version_changes(p.where("page_id % 3 <> 0"), new, "page_id")


@query("""SELECT section, row_number() OVER (PARTITION BY section ORDER BY part, ordinal) AS ordinal, text FROM (SELECT source AS section, lang AS text, min(doc_id % 2) AS part, arg_min(doc_id, (doc_id % 2, doc_id)) AS ordinal FROM documents GROUP BY 1, 2)""")
def u02_merged_sections(spark, sf):
    d = table(spark, sf, "documents")
    return C.merged_sections(d.select((F.col("doc_id") % 2).alias("part"), F.col("source").alias("section"), F.col("doc_id").alias("ordinal"), F.col("lang").alias("text")))


@query("SELECT * FROM (SELECT conv_id, speaker FROM ev INTERSECT SELECT conv_id, speaker FROM ev WHERE seq <= 3)")
def u03_intersect(spark, sf):
    m = ev(spark, sf)
    return m.select("conv_id", "speaker").intersect(m.where("seq <= 3").select("conv_id", "speaker"))


@query("SELECT * FROM (SELECT conv_id, speaker FROM ev EXCEPT SELECT conv_id, speaker FROM ev WHERE seq <= 3)")
def u03_except(spark, sf):
    m = ev(spark, sf)
    return m.select("conv_id", "speaker").subtract(m.where("seq <= 3").select("conv_id", "speaker"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, seq) AS n, text FROM (SELECT 'c' || conv_id AS conv_id, 0 AS part, seq, text FROM cv UNION ALL SELECT 'c' || conv_id, 1, seq, text FROM ev)")
def u01_concatenated(spark, sf):
    both = cv(spark, sf).select("conv_id", F.lit(0).alias("part"), "seq", "text").unionByName(ev(spark, sf).select("conv_id", F.lit(1).alias("part"), "seq", "text"))
    return both.select(F.concat(F.lit("c"), "conv_id").alias("conv_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "seq")).alias("n"), "text")


@query("SELECT speaker, arg_max(text, CAST(source_id AS BIGINT)) AS text FROM ev GROUP BY speaker")
def u06_latest(spark, sf):
    return C.latest_by_key(ev(spark, sf).withColumn("at", F.col("source_id").cast("long")), "speaker", "at").select("speaker", "text")


@query(f"""WITH k AS (SELECT *, {KEY} AS key FROM ev), u AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY conv_id, key) = 1),
    l AS (SELECT a.conv_id, a.key AS rk, b.key AS sk FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.seq = b.seq + 1 WHERE a.seq % 2 = 0)
    SELECT r.conv_id, r.seq, s.source_id AS reply_to FROM l JOIN u s ON s.conv_id = l.conv_id AND s.key = sk JOIN u r ON r.conv_id = l.conv_id AND r.key = rk WHERE s.seq < r.seq AND s.speaker <> r.speaker""")
def j05_manual_links(spark, sf):
    m = ev(spark, sf)
    k = m.select("conv_id", "seq", X.content_key("ts", "speaker", "text").alias("key"))
    links = k.where("seq % 2 = 0").withColumnRenamed("key", "reply_key").join(k.select("conv_id", (F.col("seq") + 1).alias("seq"), F.col("key").alias("source_key")), ["conv_id", "seq"]).drop("seq")
    return C.manual_links(m, links).where("reply_to <> ''").select("conv_id", "seq", "reply_to")


@query("SELECT conv_id, seq, speaker, text FROM chats WHERE seq = 2")
def j16_point_lookup(spark, sf):
    return message_at(chats(spark, sf), 2).select("conv_id", "seq", "speaker", "text")


@query("SELECT d.doc_id, d.lang, l.toxic, CASE WHEN l.quality = 1 THEN 'kept' WHEN l.quality = 0 THEN 'rejected' ELSE 'pending' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j11_decisions(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", "lang", "toxic", F.when(F.col("quality") == 1, "kept").when(F.col("quality") == 0, "rejected").otherwise("pending").alias("state"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def a24_label_counts(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS cases, count(*) FILTER (toxic = 0) AS passed, avg(quality) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def a25_evaluation_totals(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("cases"), F.count_if(F.col("toxic") == 0).alias("passed"), F.avg("quality").alias("quality"))

