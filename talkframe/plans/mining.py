"""Queries over phrases, topics, places, names, quarrels, rankings and samples."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators import evidence as V
from talkframe.operators import mining as N
from talkframe.plans.base import chat_sides, chats, dv, ev, literal, query, sides, table, zh

NOISE = ("th", "he")
NOISY = "(g <> trim(g) OR NOT regexp_matches(g, '[\\p{L}]') OR contains(g, '[') OR contains(g, ']') OR g IN ('th', 'he'))"
LINES = "l AS (SELECT conv_id, seq, speaker, pos, trim(regexp_replace(x, '\\[[^\\[\\]]{0,24}\\]', ' ', 'g')) AS line FROM (SELECT conv_id, seq, speaker, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM chats) WHERE trim(regexp_replace(x, '\\[[^\\[\\]]{0,24}\\]', ' ', 'g')) <> '')"


@query(f"WITH {LINES} SELECT conv_id, seq, speaker, line FROM l")
def p03_lines(spark, sf):
    return N.message_lines(chats(spark, sf)).drop("pos")


@query(f"""WITH {LINES}, u AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id, speaker ORDER BY seq, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM l WHERE length(line) <= 200),
    i AS (SELECT conv_id, speaker, line, n, unnest(range(1, length(line) - n + 2)) AS pos FROM u, (SELECT unnest([2, 3, 4, 5]) AS n) WHERE used <= 400000 AND length(line) >= n),
    k AS (SELECT conv_id, speaker, substr(line, pos, n) AS g FROM i)
    SELECT conv_id, speaker, g AS gram, count(*) AS n FROM k WHERE NOT {NOISY} GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def a15_gram_counts(spark, sf):
    return N.gram_counts(N.message_lines(chats(spark, sf)), noise=NOISE).where("n >= 3")


def parts_sql(of: str, by: str, gram: str, least: int, size: int) -> str:
    """CTE kp: rows of an expression that no longer gram of their group contains which is as frequent."""
    return f"""sz AS (SELECT unnest(range({least}, {size})) AS k), px AS (SELECT {by}, {gram} AS whole, k, unnest(range(1, length({gram}) - k + 2)) AS i, n FROM {of}, sz WHERE k < length({gram})),
    lg AS (SELECT {by}, substr(whole, i, k) AS {gram}, max(n) AS larger FROM px GROUP BY ALL), kp AS (SELECT {of}.* FROM {of} LEFT JOIN lg USING ({by}, {gram}) WHERE larger IS NULL OR larger < n)"""


GRAMS = f"""{LINES}, u AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id, speaker ORDER BY seq, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM l WHERE length(line) <= 200),
    i AS (SELECT conv_id, speaker, line, n, unnest(range(1, length(line) - n + 2)) AS pos FROM u, (SELECT unnest([2, 3, 4, 5]) AS n) WHERE used <= 400000 AND length(line) >= n),
    k AS (SELECT conv_id, speaker, substr(line, pos, n) AS g FROM i), gc AS (SELECT conv_id, speaker, g AS gram, count(*) AS n FROM k WHERE NOT {NOISY} GROUP BY 1, 2, 3)"""


@query(f"""WITH {GRAMS}, g3 AS (SELECT * FROM gc WHERE n >= 3), {parts_sql('g3', 'conv_id, speaker', 'gram', 1, 5)}
    SELECT conv_id, speaker, gram, n, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY n * sqrt(length(gram)) DESC, n DESC, length(gram) DESC, gram) AS rank FROM kp
    QUALIFY row_number() OVER (PARTITION BY conv_id, speaker ORDER BY n * sqrt(length(gram)) DESC, n DESC, length(gram) DESC, gram) <= 60""")
def a15_phrases(spark, sf):
    return N.absorbed(N.gram_counts(N.message_lines(chats(spark, sf)), noise=NOISE), 3, 60)


@query("""WITH t AS (SELECT conv_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM chats), i AS (SELECT conv_id, t, n, unnest(range(1, length(t) - n + 2)) AS pos FROM t, (SELECT unnest([2, 3, 4]) AS n) WHERE length(t) >= n)
    SELECT conv_id, substr(t, pos, n) AS gram, count(*) AS n FROM i GROUP BY 1, 2 HAVING count(*) >= 10""")
def a14_gram_counts(spark, sf):
    t = chats(spark, sf).select("conv_id", F.regexp_replace("text", r"\s+", "").alias("t"))
    return t.select("conv_id", F.explode(X.ngrams("t", 2, 4)).alias("gram")).groupBy("conv_id", "gram").agg(F.count("*").alias("n")).where("n >= 10")


@query()
def a14_topics(spark, sf):
    return N.topics(chats(spark, sf), cjk=False)


@query()
def a14_topics_zh(spark, sf):
    return N.topics(zh(spark), least=2, stop=L.STOP_PHRASES)


EDGE_NOISE = f"(g <> trim(g) OR NOT regexp_matches(g, '[\\p{{L}}\\p{{M}}]') OR contains(g, '[') OR contains(g, ']') OR g IN ({', '.join(map(literal, sorted(X.noise_fragments())))}))"


@query(f"""WITH {LINES}, e AS (SELECT conv_id, speaker, 'head' AS side, substr(line, 1, 3) AS g FROM l WHERE length(line) BETWEEN 3 AND 80 UNION ALL SELECT conv_id, speaker, 'tail', right(line, 3) FROM l WHERE length(line) BETWEEN 3 AND 80),
    c AS (SELECT conv_id, speaker, side, g AS gram, count(*) AS n FROM e WHERE NOT {EDGE_NOISE} GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)
    SELECT *, row_number() OVER (PARTITION BY conv_id, speaker, side ORDER BY n DESC, gram) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, speaker, side ORDER BY n DESC, gram) <= 10""")
def a16_line_edges(spark, sf):
    return N.edges(N.message_lines(chats(spark, sf)), least=2)


def clauses_sql(of: str, most: int = 80) -> str:
    """CTE cl: the most frequent clauses of each speaker of lines."""
    return f"""cp AS (SELECT conv_id, speaker, seq, trim(unnest(regexp_split_to_array(line, {literal(L.CLAUSE_SPLIT)}))) AS g FROM {of}),
    cl AS (SELECT conv_id, speaker, g AS clause, count(*) AS n, min(seq) AS first, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY count(*) DESC, min(seq), g) AS rank FROM cp WHERE length(g) BETWEEN 2 AND 12 AND NOT {NOISY}
        GROUP BY 1, 2, 3 QUALIFY rank <= {most})"""


def distinctive_sql(most: int = 12) -> str:
    """CTE ds: a target's distinctive clauses."""
    times = lambda speaker, name: f"(SELECT f.conv_id, f.clause, CAST(sum((length(line) - length(replace(line, clause, ''))) // length(clause)) AS BIGINT) AS {name} FROM cl f JOIN sides s ON s.conv_id = f.conv_id AND f.speaker = s.target JOIN l ON l.conv_id = f.conv_id AND l.speaker = s.{speaker} AND contains(l.line, f.clause) GROUP BY 1, 2)"
    chars = lambda speaker, name: f"(SELECT l.conv_id, sum(length(line)) AS {name} FROM l JOIN sides s ON s.conv_id = l.conv_id AND l.speaker = s.{speaker} GROUP BY 1)"
    return f"""{LINES}, {clauses_sql('l')}, dd AS (SELECT conv_id, clause, n, CASE WHEN coalesce(other_chars, 0) >= 200 THEN (n / greatest(chars, 1) + 1e-6) / (coalesce(theirs, 0) / other_chars + 1e-6) ELSE 1.0 END AS ratio, coalesce(other_chars, 0) >= 200 AS enough, chars
        FROM {times('target', 'n')} LEFT JOIN {times('counterpart', 'theirs')} USING (conv_id, clause) JOIN {chars('target', 'chars')} USING (conv_id) LEFT JOIN {chars('counterpart', 'other_chars')} USING (conv_id)),
    de AS (SELECT conv_id, clause, n, CAST(ratio AS DOUBLE) AS ratio FROM dd WHERE n >= CASE WHEN chars < 500 THEN 2 ELSE 3 END AND (NOT enough OR ratio >= 1.5)), {parts_sql('de', 'conv_id', 'clause', 1, 12)},
    ds AS (SELECT conv_id, clause AS phrase, n, ratio, row_number() OVER (PARTITION BY conv_id ORDER BY sqrt(n) * ratio * sqrt(length(clause)) DESC, clause) AS rank FROM kp QUALIFY rank <= {most})"""


@query(f"WITH {LINES}, {clauses_sql('l')} SELECT conv_id, speaker, clause, n, rank FROM cl")
def a17_clauses(spark, sf):
    return N.clauses(N.message_lines(chats(spark, sf)), noise=NOISE).drop("first")


@query(f"WITH {distinctive_sql()} SELECT conv_id, phrase, n, round(ratio, 6) AS ratio FROM ds")
def a17_distinctive(spark, sf):
    found = N.distinctive(chats(spark, sf), chat_sides(spark, sf), expressive=False, noise=NOISE)
    return found.select("conv_id", "phrase", "n", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {distinctive_sql()}, sp AS (SELECT ds.conv_id, phrase, count(DISTINCT session_id) AS sessions FROM ds JOIN sides s ON s.conv_id = ds.conv_id JOIN ch_s c ON c.conv_id = ds.conv_id AND c.speaker = s.target AND contains(c.text, phrase) GROUP BY 1, 2)
    SELECT conv_id, phrase FROM ds JOIN (SELECT conv_id, bool_or(ts IS NULL) AS untimed FROM ch_s GROUP BY 1) USING (conv_id) LEFT JOIN sp USING (conv_id, phrase) WHERE untimed OR sessions >= 2""")
def a18_session_coverage(spark, sf):
    m = chats(spark, sf)
    found = N.distinctive(m, chat_sides(spark, sf), expressive=False, noise=NOISE).select("conv_id", "phrase")
    return N.session_coverage(m, found, chat_sides(spark, sf)).select("conv_id", "phrase")


def _side_sql(name: str, speaker: str, least: int) -> str:
    """CTE of a side's grams that aren't parts of as frequent ones, the best 200."""
    parts = parts_sql(f"{name}_c", "conv_id", "gram", 1, 5)
    for x in ("sz", "px", "lg", "kp"):
        parts = re.sub(rf"\b{x}\b", f"{name}_{x}", parts)
    return f"""{name}_c AS (SELECT conv_id, gram, sum(n) AS n FROM gc JOIN sides USING (conv_id) WHERE speaker = {speaker} GROUP BY 1, 2 HAVING sum(n) >= {least}), {parts},
    {name} AS (SELECT conv_id, gram, n FROM {name}_kp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n * sqrt(length(gram)) DESC, n DESC, length(gram) DESC, gram) <= 200)"""


@query(f"""WITH {GRAMS}, {_side_sql('t2', 'target', 2)}, {_side_sql('o2', 'counterpart', 2)}, {_side_sql('t3', 'target', 3)}, {_side_sql('o1', 'counterpart', 1)},
    bt AS (SELECT conv_id, gram, least(t2.n, o2.n) AS n, 'both' AS kind FROM t2 JOIN o2 USING (conv_id, gram)), mn AS (SELECT conv_id, gram, t3.n AS n, 'target' AS kind FROM t3 JOIN o1 USING (conv_id, gram)),
    al AS (SELECT * FROM bt UNION ALL SELECT mn.* FROM mn ANTI JOIN bt USING (conv_id, gram))
    SELECT conv_id, gram, CAST(n AS BIGINT) AS n, kind, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, length(gram) DESC, gram) AS rank FROM al QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, length(gram) DESC, gram) <= 6""")
def a19_shared_phrases(spark, sf):
    return N.shared_phrases(chats(spark, sf), chat_sides(spark, sf), noise=NOISE)


@query()
def a20_places(spark, sf):
    return N.places(chats(spark, sf))


@query()
def a21_names(spark, sf):
    return N.names(chats(spark, sf), (*L.PET_NAMES, "elle", "elle"))


QUARREL = (*L.CONFLICT_WORDS, "error", "pas")


@query(f"""WITH w AS (SELECT conv_id, session_id, seq, speaker, text, list_filter([{', '.join(map(literal, dict.fromkeys(QUARREL)))}], lambda x: contains(text, x)) AS hit FROM ch_s),
    s AS (SELECT conv_id, session_id, count(*) AS messages, len(list_distinct(flatten(list(hit)))) AS words, min(seq) FILTER (len(hit) > 0) AS first_seq, arg_max(speaker, seq) FILTER ({" OR ".join(f"contains(text, {literal(p)})" for p in L.PEACE_WORDS)}) AS peace_speaker FROM w GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY words * pow(messages, 0.3) DESC, session_id) AS rank, CASE WHEN words >= 2 THEN 'conflict' ELSE 'spat' END AS severity FROM s WHERE messages >= 3 AND words >= 1
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY words * pow(messages, 0.3) DESC, session_id) <= 4""")
def t07_quarrels(spark, sf):
    return N.quarrels(chats(spark, sf), QUARREL)


@query()
def t08_sweet_moments(spark, sf):
    return N.sweet_moments(zh(spark))


@query()
def t05_examples(spark, sf):
    return N.examples(chats(spark, sf), ("下次一定", "the"))


@query("""SELECT conv_id, speaker, n, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first_seq) AS rank FROM (SELECT conv_id, speaker, count(*) AS n, min(seq) AS first_seq FROM ev GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first_seq) <= 3""")
def t01_most_common(spark, sf):
    by = ev(spark, sf).groupBy("conv_id", "speaker").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return N.most_common(by, ["conv_id"], 3, "first_seq").drop("first_seq")


@query("""WITH x AS (SELECT conv_id, seq, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM dv)
    SELECT conv_id, seq FROM x WHERE i % greatest(n // 6, 1) = 0 AND i // greatest(n // 6, 1) < 6""")
def t06_strided(spark, sf):
    return N.strided(dv(spark, sf), ["seq"], ["conv_id"], 6).select("conv_id", "seq")


@query("""WITH x AS (SELECT conv_id, seq, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM dv)
    SELECT conv_id, seq FROM x WHERE n <= 5 OR i IN (SELECT CAST(round_even(k * (n - 1) / 4, 0) AS BIGINT) FROM (SELECT unnest(range(0, 5)) AS k))""")
def t09_spread(spark, sf):
    return N.spread(dv(spark, sf), ["seq"], ["conv_id"], 5).select("conv_id", "seq")


@query("""SELECT conv_id, arg_min(text, (-length(text), seq)) AS best FROM chats GROUP BY conv_id""")
def t13_best(spark, sf):
    return N.best(chats(spark, sf), ["conv_id"], "text", -F.length("text"), "seq")


def containing(spark, sf):
    """(item_id, doc_id) of benchmark passages in documents."""
    items = table(spark, sf, "benchmark").select(F.lit("all").alias("conv_id"), "item_id", F.col("text").alias("claim"))
    docs = table(spark, sf, "documents").select(F.lit("all").alias("conv_id"), F.col("doc_id").alias("seq"), "text")
    return V.quoting(items, docs).select("item_id", F.col("seq").alias("doc_id"))


@query("""WITH t AS (SELECT d.doc_id, b.item_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) - 1 AS i, count(*) OVER (PARTITION BY b.item_id) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text))
    SELECT item_id, doc_id FROM t WHERE i % greatest(n // 3, 1) = 0 AND i // greatest(n // 3, 1) < 3""")
def j12_topic_excerpts(spark, sf):
    return N.strided(containing(spark, sf), ["doc_id"], ["item_id"], 3)


@query()
def a20_top_places(spark, sf):
    by = N.places(chats(spark, sf))
    return N.most_common(by, ["conv_id"], 8, "first").drop("first")


@query()
def a17_distinctive_zh(spark, sf):
    m = zh(spark)
    return N.distinctive(m, sides(spark), banned=N.places(m).select("conv_id", F.col("place").alias("name")))
