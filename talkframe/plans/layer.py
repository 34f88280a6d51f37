"""Queries over the reference layer, saved states, comparisons and increments."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.operators import evidence as V
from talkframe.operators import exchanges as E
from talkframe.operators import layer as Y
from talkframe.operators import mining as N
from talkframe.operators import packs as K
from talkframe.operators import trials as T
from talkframe.operators.messages import with_ordinals
from talkframe.plans.base import cv, ev, literal, query, sides, table, zh
from talkframe.plans.evidence import _items
from talkframe.plans.exchanges import ALTERNATE_LAB, alternate_pairs, zh_pairs

@query("""WITH t AS (SELECT conv_id, seq, ts, speaker, gram, rank FROM (SELECT conv_id, seq, ts, speaker, text FROM ev) JOIN (VALUES ('"k": 1', 1), ('"k": 2', 2)) g(gram, rank) ON contains(text, gram)),
    x AS (SELECT *, row_number() OVER (PARTITION BY conv_id, gram ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY conv_id, gram) AS n FROM t)
    SELECT conv_id, gram, seq, speaker FROM x WHERE i % greatest(n // 5, 1) = 0 AND i // greatest(n // 5, 1) < 5""")
def k03_topic_excerpts(spark, sf):
    m = ev(spark, sf)
    topics = m.select("conv_id").distinct().select("conv_id", F.inline(F.array(*(F.struct(F.lit(f'"k": {k}').alias("gram"), F.lit(k).alias("rank")) for k in (1, 2)))))
    return Y.topic_excerpts(m, topics, 5).select("conv_id", "gram", "seq", "speaker")


@query()
def k03_topic_document(spark, sf):
    return Y.topic_document(zh(spark), N.topics(zh(spark), least=2, stop=L.STOP_PHRASES))


@query()
def v08_evidence_document(spark, sf):
    return Y.evidence_document(Y.evidence_rows(_items(spark).drop("claim"), zh(spark)))


BUDGET = 60_000


@query(f"""WITH l AS (SELECT conv_id, strftime(ts, '%Y-%m') AS month, seq, strftime(ts, '%Y-%m-%d %H:%M') || ' ' || speaker || '：' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM ev),
    m AS (SELECT conv_id, month, '# ' || month || '（' || count(*) || ' 条）' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY seq) || chr(10) AS body FROM l GROUP BY 1, 2),
    s AS (SELECT conv_id, month, strlen(body) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY month DESC) AS back FROM m),
    c AS (SELECT *, sum(bytes) OVER (PARTITION BY conv_id ORDER BY back) AS upto FROM s)
    SELECT conv_id, 'transcript/' || month || '.md' AS path, bytes FROM c WHERE back = 1 OR upto + 5 <= {BUDGET}
    UNION ALL SELECT DISTINCT conv_id, 'topics.md', 5 FROM ev
    UNION ALL SELECT conv_id, 'source/' || speaker || '.txt', sum(strlen(text)) + count(*) - 1 FROM ev GROUP BY conv_id, speaker HAVING sum(strlen(text)) + count(*) - 1 BETWEEN 1 AND {BUDGET}""")
def k04_assembled(spark, sf):
    """Files of the layer within a budget; here no month is larger than what is left after a smaller one."""
    m = ev(spark, sf)
    docs = m.select("conv_id").distinct().select("conv_id", F.inline(F.array(F.struct(F.lit("topics.md").alias("path"), F.lit("words").alias("body")), F.struct(F.lit("empty.md").alias("path"), F.lit(" ").alias("body")))))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    small = m.groupBy("conv_id", "speaker").agg((F.sum(F.octet_length(F.coalesce("text", F.lit("")))) + F.count("*") - 1).alias("n")).where(F.col("n") <= BUDGET)
    sources = m.join(small, ["conv_id", "speaker"], "left_semi").groupBy("conv_id", F.concat("speaker", F.lit(".txt")).alias("name")).agg(texts.alias("body"))
    return Y.assembled(docs, m, BUDGET, redact=False, sources=sources, source_cap=BUDGET).where("path <> 'README.md'").select("conv_id", "path", "bytes")


@query()
def k09_coverage_markdown(spark, sf):
    return Y.coverage_markdown(E.coverage(zh_pairs(spark), E.scenarios(zh_pairs(spark)), zh(spark), sides(spark)))


@query()
def k09_specificity_markdown(spark, sf):
    items = _items(spark)
    found = V.specificity(items.select("conv_id", "item_id", "text", "claim"), zh(spark), sides(spark).select("conv_id", "target"))
    return Y.specificity_markdown(found, items)


@query()
def k05_memory_markdown(spark, sf):
    return Y.memory_markdown(V.ledger(_items(spark), zh(spark)), _items(spark))


@query("""SELECT source AS conv_id, '# d' || chr(10) || chr(10) || string_agg('## ' || lang || chr(10) || chr(10) || CASE WHEN lang = 'de' THEN '> note' || chr(10) || chr(10) ELSE '' END || lines || chr(10), chr(10) ORDER BY lang) AS markdown
    FROM (SELECT source, lang, string_agg('- ' || n_chars, chr(10) ORDER BY doc_id) AS lines FROM documents GROUP BY 1, 2) GROUP BY source""")
def k05_sections(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("conv_id"), F.col("lang").alias("place"), F.col("lang").alias("section"), F.col("doc_id").alias("ordinal"), F.col("n_chars").cast("string").alias("text"))
    return Y.sections_markdown(d, "d", {"de": "note"})


@query("SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN '用户补充（未经聊天记录核实）：' || conv_id ELSE {0} END AS identity FROM conversations".format(literal(L.IDENTITY_NOTICE)))
def a33_identity(spark, sf):
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    return ids.select("conv_id", Y.identity(F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string"))).alias("identity"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents)
    SELECT doc_id, CASE WHEN len(lines) BETWEEN 2 AND 3 THEN array_to_string(lines, chr(10)) ELSE array_to_string(lines, ' ') END AS text FROM l""")
def x13_unwrapped(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Y.unwrapped(F.col("text")).alias("text"))


@query("""WITH RECURSIVE d AS (SELECT source AS conv_id, lang AS section, doc_id, doc_id % 3 AS batch, row_number() OVER (PARTITION BY source, lang, doc_id % 3 ORDER BY doc_id) AS ordinal, length(to_json(text)::VARCHAR) AS size, length(to_json(lang)::VARCHAR) AS name FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
    i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY section, ordinal, batch) AS n FROM d),
    f AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS doc_id, false AS kept, CAST(4 * (max(batch) + 1) AS BIGINT) AS used, '' AS section, CAST([] AS BIGINT[]) AS opened, CAST([] AS BIGINT[]) AS started FROM d GROUP BY conv_id
        UNION ALL SELECT conv_id, n, doc_id, fits, CASE WHEN fits THEN used + more ELSE used END, section, CASE WHEN fits THEN list_append(opened, batch) ELSE opened END, CASE WHEN fits THEN list_append(started, batch) ELSE started END FROM (
            SELECT *, used + more <= 20000 AS fits FROM (SELECT conv_id, n, doc_id, section, batch, used, started, opened, size + CASE WHEN list_contains(opened, batch) THEN 2 ELSE name + 4 + CASE WHEN list_contains(started, batch) THEN 2 ELSE 0 END END AS more FROM (
                SELECT i.conv_id, i.n, i.doc_id, i.section, i.batch, i.size, i.name, f.used, f.started, CASE WHEN f.section = i.section THEN f.opened ELSE CAST([] AS BIGINT[]) END AS opened FROM f JOIN i ON i.conv_id IS NOT DISTINCT FROM f.conv_id AND i.n = f.n + 1)))
    ) SELECT conv_id, doc_id FROM f WHERE kept""")
def t12_round_robin(spark, sf):
    """Documents of a source as drafts of three batches, its languages as sections."""
    d = table(spark, sf, "documents").where("lang IS NOT NULL AND text IS NOT NULL").withColumn("batch", F.col("doc_id") % 3)
    items = with_ordinals(d, ["source", "lang", "batch"], "doc_id").select(F.col("source").alias("conv_id"), F.col("lang").alias("section"), F.col("lang").alias("section_place"), "ordinal", "batch", "text", "doc_id")
    return Y.round_robin(items, 20_000).select("conv_id", "doc_id")


@query()
def q17_envelopes(spark, sf):
    routes = E.scenarios(zh_pairs(spark))
    return Y.envelope(E.routed(zh(spark).where("speaker = '小雨'").select("conv_id", F.col("seq").alias("id"), "text"), routes))


@query("SELECT conv_id, seq, conv_id % 2 <> 0 AS stale FROM (SELECT conv_id, turn + 1 AS seq FROM conversations)")
def q11_freshness(spark, sf):
    m = cv(spark, sf)
    current = m.select("conv_id").distinct().select("conv_id", F.lit("now").alias("fingerprint"))
    saved = m.select("conv_id", "seq", F.when(F.col("conv_id").cast("long") % 2 == 0, "now").otherwise("before").alias("fingerprint"))
    return T.freshness(saved, current).select("conv_id", "seq", "stale")


@query("""SELECT conv_id, CAST(max(turn + 1) AS VARCHAR) AS id, left(arg_max(text, turn), 50) AS reply FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id, role""")
def q11_recorded(spark, sf):
    """The last reply of each side's case, of conversations whose content stayed the same."""
    m = cv(spark, sf)
    current = m.select("conv_id").distinct().select("conv_id", F.lit("now").alias("fingerprint"))
    rows = m.select("conv_id", F.col("speaker").alias("id"), F.col("text").alias("reply"), F.when(F.col("conv_id").cast("long") % 2 == 0, "now").otherwise("before").alias("fingerprint"), F.col("seq").alias("at"))
    out = T.recorded(rows.where("at <= 2"), rows.where("at > 2"), current, rows, 50)
    return out.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("at").cast("string").alias("id"), "reply")


@query()
def q13_holdout_summary(spark, sf):
    return T.holdout_summary(ev(spark, sf), 25)


@query("""WITH v AS (SELECT conv_id, CAST(turn AS VARCHAR) AS id, CASE turn % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'tie' END AS side FROM conversations WHERE turn > 0)
    SELECT CAST(c.conv_id AS VARCHAR) AS conv_id, count(*) AS cases, count(side) AS chosen, count(*) FILTER (side = 'a') AS a_wins, count(*) FILTER (side = 'b') AS b_wins, count(*) = count(side) AS revealed
    FROM conversations c LEFT JOIN v ON v.conv_id = c.conv_id AND v.id = CAST(c.turn AS VARCHAR) GROUP BY 1""")
def q14_blind_comparison(spark, sf):
    """Votes by place in a blind run, where voters see the order; wins must come out by side whatever the draw."""
    cases = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("id"))
    run = T.comparison(cases, 7)
    results = run.select("conv_id", "id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side")).withColumn("reply", F.concat("side", F.lit("!")))
    seen = T.shown_results(run, results)
    meant = F.col("id").cast("int") % 3
    wanted = seen.where(F.left("reply", F.lit(1)) == F.when(meant == 0, "a").otherwise("b")).select("conv_id", "id", F.when(meant == 2, "tie").otherwise(F.col("shown")).alias("choice"), F.lit(1).alias("at"))
    return T.verdict(run, T.choices(run, results, wanted.where("id <> '0'")))


@query("""WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn % 4 = 0 AS again, turn FROM conversations WHERE conv_id % 2 = 0),
    s AS (SELECT conv_id, CASE WHEN again OR turn % 3 = 1 THEN 'b' WHEN turn % 3 = 0 THEN 'a' ELSE 'tie' END AS won, again OR turn % 2 = 0 AS pa, turn % 3 = 0 AS pb, CASE WHEN again THEN 1 ELSE turn * 0.25 END AS ta, turn * 0.5 AS tb FROM r)
    SELECT conv_id, 'a' AS side, count(*) FILTER (won = 'a') AS wins, count(*) FILTER (pa) AS passed, round_even(CAST(sum(ta) AS DOUBLE), 1) AS seconds FROM s GROUP BY 1
    UNION ALL SELECT conv_id, 'b', count(*) FILTER (won = 'b'), count(*) FILTER (pb), round_even(CAST(sum(tb) AS DOUBLE), 1) FROM s GROUP BY 1""")
def q14_summary(spark, sf):
    """Every case is voted on, then one in four gets a new reply, and only conversations of even numbers vote on those again."""
    cases = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("id"))
    run, turn = T.comparison(cases, 7), F.col("id").cast("int")
    got = lambda side, passed, seconds, at: F.struct(F.lit(side).alias("side"), passed.alias("passed"), seconds.cast("double").alias("seconds"), F.lit(at).alias("at"))
    told = [got("a", turn % 2 == 0, turn * 0.25, 1), got("b", turn % 3 == 0, turn * 0.5, 1), F.when(turn % 4 == 0, got("a", F.lit(True), F.lit(1.0), 3))]
    results = run.select("conv_id", "id", F.inline(F.filter(F.array(*told), lambda x: x.isNotNull())))
    place = lambda side: F.when(F.col("first") == side, "a").otherwise("b")
    before = run.select("conv_id", "id", F.when(turn % 3 == 0, place("a")).when(turn % 3 == 1, place("b")).otherwise("tie").alias("choice"), F.lit(2).alias("at"))
    after = run.where((turn % 4 == 0) & (F.col("conv_id").cast("long") % 2 == 0)).select("conv_id", "id", place("b").alias("choice"), F.lit(4).alias("at"))
    return T.summary(run, results, T.choices(run, results, before.unionByName(after)))


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, count(*) AS messages FROM conversations GROUP BY 1")
def r02_applied_increment(spark, sf):
    """Known messages are those of even places, incoming ones all: every message is there once after it."""
    m = cv(spark, sf)
    sections = spark.createDataFrame([("s", 1, "old")], "section string, ordinal int, text string")
    analyse = lambda added: added.groupBy().agg(F.count("*").cast("string").alias("text")).select(F.lit("s").alias("section"), F.lit(1).alias("ordinal"), "text")
    memory = spark.createDataFrame([], "conv_id string, memory_id long, status string, quote string")
    got = T.applied_increment(m.where("seq % 2 = 1"), m, sections, memory.drop("quote"), memory, analyse)
    return got.messages.groupBy("conv_id").agg(F.count("*").alias("messages"))


@query("SELECT source AS conv_id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE '' END AS folder, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2 UNION ALL SELECT source, NULL, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY 1")
def a28_sizes(spark, sf):
    d = table(spark, sf, "documents")
    return K.sizes(d.select(F.col("source").alias("conv_id"), F.concat(F.when(F.col("doc_id") % 2 == 0, "a/").otherwise(""), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("bytes")))


@query(f"""WITH {ALTERNATE_LAB}, s AS (SELECT conv_id, array_to_string(incoming, chr(10)) AS mine, array_to_string(reply, chr(10)) AS theirs, incoming, reply, reply_messages[1] AS first FROM lab)
    SELECT conv_id, first, NOT regexp_matches(mine || chr(10) || theirs, '\\[(?:{'|'.join(L.EXAMPLE_BAD_MARKS)})\\]') AND length(mine) BETWEEN 4 AND 28 AND length(theirs) <= 26 AND len(reply) BETWEEN 1 AND 3 AND length(trim(regexp_replace(mine, '\\[[^\\[\\]]*\\]', '', 'g'))) >= 3 AND length(trim(regexp_replace(theirs, '\\[[^\\[\\]]*\\]', '', 'g'))) >= 2 AS usable FROM s""")
def p11_usable_examples(spark, sf):
    return alternate_pairs(spark, sf).select("conv_id", F.get("reply_messages", F.lit(0)).alias("first"), Y.usable_example(F.col("incoming"), F.col("reply")).alias("usable"))
