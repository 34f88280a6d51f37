"""Queries over rendering, titles, stored rows, hold-out cases and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators import exchanges as E
from talkframe.operators import messages as M
from talkframe.operators import packs as K
from talkframe.operators import profile as P
from talkframe.operators import render as W
from talkframe.operators import trials as T
from talkframe.plans.base import chats, cv, ev, literal, query, sides, table, values, zh
from talkframe.plans.exchanges import zh_pairs

TITLES = [(r, f, t) for r, names in L.SECTION_TITLES.items() for f, t in zip(L.MEMORY_KINDS, names, strict=True)]


@query(f"""WITH {values('t', 'relation, field, title', TITLES)}, s AS (SELECT DISTINCT CASE lang WHEN 'de' THEN '同事' WHEN 'fr' THEN '恋人' ELSE lang END AS relation FROM documents), f AS (SELECT unnest(['关系时间线', '甜蜜瞬间', 'other']) AS field)
    SELECT s.relation, f.field, coalesce(title, f.field) AS title FROM s CROSS JOIN f LEFT JOIN t ON t.field = f.field AND t.relation = CASE WHEN s.relation IN ('恋人', '朋友', '同事', '家人') THEN s.relation ELSE '朋友' END""")
def j17_titles(spark, sf):
    relation = F.when(F.col("lang") == "de", "同事").when(F.col("lang") == "fr", "恋人").otherwise(F.col("lang"))
    s = table(spark, sf, "documents").select(relation.alias("relation")).distinct().select("relation", F.explode(F.array(F.lit("关系时间线"), F.lit("甜蜜瞬间"), F.lit("other"))).alias("field"))
    return W.titled(s)


@query()
def k05_profile_lines(spark, sf):
    return W.profile_markdown(P.speaker_profile(chats(spark, sf)))


@query()
def k09_scenarios(spark, sf):
    return W.scenario_markdown(E.scenarios(zh_pairs(spark)))


@query("SELECT source AS conv_id, string_agg('## ' || lang || chr(10) || chr(10) || lines || chr(10), chr(10) ORDER BY lang) AS markdown FROM (SELECT source, lang, string_agg('- ' || n_chars, chr(10) ORDER BY doc_id) AS lines FROM documents GROUP BY 1, 2) GROUP BY source")
def k05_bullets(spark, sf):
    d = table(spark, sf, "documents")
    return W.bullets(d.select(F.col("source").alias("conv_id"), F.col("lang").alias("section"), F.col("doc_id").alias("ordinal"), F.col("n_chars").cast("string").alias("text")))


@query("SELECT conv_id, CAST(seq - 1 AS INTEGER) AS n, date_trunc('minute', ts) AS ts, speaker, text FROM zh WHERE speaker <> ''")
def s17_transcript_rows(spark, sf):
    lines = K.transcript_lines(zh(spark)).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return W.transcript_rows(lines)


@query("SELECT conv_id, seq, speaker, text FROM cv WHERE trim(speaker) <> 'system'")
def s18_rows_with_speaker(spark, sf):
    rows = cv(spark, sf).withColumn("speaker", F.when(F.col("speaker") == "system", " ").otherwise(F.col("speaker")))
    return M.with_speaker(rows).select("conv_id", "seq", "speaker", "text")


@query("SELECT conv_id, seq FROM chats WHERE length(text) BETWEEN 2 AND 28 AND NOT regexp_matches(text, '^(\\s*\\[[^\\[\\]]*\\]\\s*)+$')")
def p11_usable_lines(spark, sf):
    return chats(spark, sf).where(F.length("text").between(2, 28) & ~X.is_media_only("text")).select("conv_id", "seq")


@query("SELECT conv_id, map_from_entries(list((speaker, n) ORDER BY speaker)) ['view'] AS views, len(list(speaker)) AS speakers FROM (SELECT conv_id, speaker, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY conv_id")
def c02_count_maps(spark, sf):
    return M.counted(ev(spark, sf)).select("conv_id", F.try_element_at("counts", F.lit("view")).alias("views"), F.size("counts").alias("speakers"))


@query("SELECT conv_id, seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END AS iso, ts AS back FROM ev")
def d04_iso_round_trip(spark, sf):
    iso = X.iso("ts")
    return ev(spark, sf).select("conv_id", "seq", iso.alias("iso"), iso.cast("timestamp_ntz").alias("back"))


@query()
def q13_holdout_cases(spark, sf):
    return T.holdout_cases(zh(spark), sides(spark), 40).select("conv_id", "id", "prompt", "allowed_quotes", "label")


@query(f"SELECT conv_id, seq, CASE WHEN regexp_matches(text, {literal(L.DISTRESS)}) THEN 'comfort' WHEN length(text) <= 4 THEN 'follow_up' ELSE 'chat' END AS intent FROM chats")
def q03_intent(spark, sf):
    t = F.col("text")
    return chats(spark, sf).select("conv_id", "seq", F.when(t.rlike(L.DISTRESS), "comfort").when(F.length(t) <= 4, "follow_up").otherwise("chat").alias("intent"))


@query("SELECT conv_id, count(*) AS rows, max(seq) AS last FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) <= 200) GROUP BY conv_id")
def r06_bounded_tail(spark, sf):
    """The last 200 rows of each log, as the feature is."""
    tail = T.last_rows(ev(spark, sf), "conv_id", "seq")
    return tail.groupBy("conv_id").agg(F.count("*").alias("rows"), F.max("seq").alias("last"))
