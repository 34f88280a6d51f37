"""Queries over exchanges, situations, scenarios and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators import exchanges as E
from talkframe.plans.base import chat_sides, chats, cv, dv, literal, query, sides, table, zh

MOST = 400
MEDIA = "regexp_full_match(text, '(\\s*\\[[^\\[\\]]*\\]\\s*)+')"
MARK = f"regexp_matches(text, {literal(L.UNRESOLVED_REPLY)})"
ADJACENT = f"""r AS (SELECT conv_id, session_id, run_id, min(speaker) AS speaker, bool_or(reply_to <> '' OR {MARK}) AS blocked, count(*) FILTER (trim(text) <> '' AND NOT {MEDIA}) AS n,
        coalesce(sum(length(trim(text))) FILTER (trim(text) <> '' AND NOT {MEDIA}), 0) AS chars, list(trim(text) ORDER BY seq) FILTER (trim(text) <> '' AND NOT {MEDIA}) AS lines, list(seq ORDER BY seq) FILTER (trim(text) <> '' AND NOT {MEDIA}) AS numbers FROM ch_r GROUP BY 1, 2, 3),
    p AS (SELECT *, NOT blocked AND n BETWEEN 1 AND 3 AND chars <= {MOST} AS fits FROM r),
    q AS (SELECT *, lead(speaker) OVER w AS s2, lead(fits) OVER w AS f2, lead(lines) OVER w AS l2, lead(numbers) OVER w AS n2 FROM p WINDOW w AS (PARTITION BY conv_id, session_id ORDER BY run_id)),
    adj AS (SELECT conv_id, session_id, lines AS incoming, l2 AS reply, numbers AS incoming_messages, n2 AS reply_messages FROM q JOIN sides USING (conv_id) WHERE speaker = counterpart AND s2 = target AND fits AND f2)"""


def _marked(text: str) -> str:
    return f"regexp_matches({text}, {literal(L.UNRESOLVED_REPLY)})"


def _media(text: str) -> str:
    return MEDIA.replace("text", text)


def pairs_sql(of: str, sides_: str, most: int) -> str:
    """CTEs that end in prs: adjacent and explicit pairs of an expression with sessions and runs (conv_id, session_id, run_id, ...)."""
    ok = [f"coalesce(a{k}.speaker = target AND a{k}.plain AND (a{k}.ts IS NULL OR ts IS NULL OR (epoch_us(a{k}.ts) - epoch_us(ts)) / 60e6 BETWEEN 0 AND 30), false)" for k in (1, 2, 3)]
    ok = [" AND ".join(ok[:k]) for k in (1, 2, 3)]
    leads = ", ".join(f"lead({{'speaker': speaker, 'plain': plain, 'ts': ts, 'text': text, 'seq': seq}}, {k}) OVER w AS a{k}" for k in (1, 2, 3))
    more = lambda f: "list_concat(" + ", ".join(f"CASE WHEN {o} THEN [a{k}.{f}] ELSE [] END" for k, o in enumerate(ok[:2], 1)) + ")"
    adj = ADJACENT.replace("ch_r", of).replace("sides", sides_).replace(f"<= {MOST}", f"<= {most}")
    return f"""{adj},
    pl AS (SELECT *, reply_to = '' AND NOT {MARK} AS plain FROM {of}), ld AS (SELECT *, {leads} FROM pl WINDOW w AS (PARTITION BY conv_id ORDER BY seq)),
    un AS (SELECT conv_id, source_id AS of_id, any_value(seq) AS s_seq, any_value(speaker) AS s_speaker, any_value(text) AS s_text, any_value(reply_to) AS s_reply FROM {of} WHERE source_id <> '' GROUP BY 1, 2 HAVING count(*) = 1),
    ht AS (SELECT l.*, s.target, un.* EXCLUDE (conv_id) FROM ld l JOIN {sides_} s ON s.conv_id = l.conv_id AND l.speaker = s.target JOIN un ON un.conv_id = l.conv_id AND un.of_id = l.reply_to
        WHERE l.reply_to <> '' AND s_seq < l.seq AND s_speaker = s.counterpart AND s_reply = '' AND NOT {_marked("s_text")}),
    ex AS (SELECT conv_id, session_id, [s_text] AS incoming, list_concat([trim(regexp_replace(text, {literal(L.UNRESOLVED_REPLY)}, '', 'g'))], {more("text")}) AS reply, [s_seq] AS incoming_messages, list_concat([seq], {more("seq")}) AS reply_messages
        FROM ht WHERE NOT ({ok[2]})),
    prs AS (SELECT *, 'adjacent' AS pairing FROM adj UNION ALL SELECT *, 'explicit_reference' FROM ex
        WHERE len(list_filter(list_concat(incoming, reply), lambda x: x = '' OR {_media("x")})) = 0 AND length(array_to_string(incoming, '')) <= {most} AND length(array_to_string(reply, '')) <= {most})"""


def picks_sql(of: str, by: tuple[str, ...], limit: int) -> str:
    """CTEs that end in picked: rows of an expression chosen in `limit` rounds for each group, with their rank."""
    keys = ", ".join(by)
    out = [f"""bs AS (SELECT *, reply_messages[1] AS at, array_to_string(reply, '') AS said, CASE WHEN action <> '' THEN 3 ELSE 0 END AS worth, list_distinct(regexp_extract_all(array_to_string(reply, ''), '(?s).')) AS signs FROM {of}
        QUALIFY row_number() OVER (PARTITION BY {keys}, incoming, reply ORDER BY reply_messages[1]) = 1)"""]
    for k in range(1, limit + 1):
        before = [f"p{j}" for j in range(1, k)]
        used = "list_concat(" + ", ".join(f"{p}.signs" for p in before) + ")" if len(before) > 1 else "p1.signs" if before else "[]"
        again = lambda c: " + ".join(f"CAST(b.{c} = {p}.{c} AS INTEGER)" for p in before) or "0"  # noqa: E731, B023
        joins = " ".join(f"JOIN {p} ON " + " AND ".join(f"{p}.{x} = b.{x}" for x in by) for p in before)
        fresh = "len(b.signs)" if not before else f"len(list_filter(b.signs, lambda x: NOT list_contains({used}, x)))"
        score = f"b.worth + 2 * ({fresh} / greatest(len(b.signs), 1)) + CAST(least(length(b.said), 30) AS DOUBLE) / 30 - 3 * ({again('label')}) - 2 * ({again('session_id')})"
        free = " AND ".join(f"b.at <> {p}.at" for p in before) or "true"
        out.append(f"p{k} AS (SELECT b.* FROM bs b {joins} WHERE {free} QUALIFY row_number() OVER (PARTITION BY {', '.join('b.' + x for x in by)} ORDER BY {score} DESC, b.at) = 1)")
    out.append("picked AS (" + " UNION ALL ".join(f"SELECT *, {k} AS rank FROM p{k}" for k in range(1, limit + 1)) + ")")
    return ",\n    ".join(out)


def labelled_sql(of: str, situations) -> str:
    """CTE lab: pairs with label and action."""
    incoming, reply = "array_to_string(incoming, ' ')", "array_to_string(reply, ' ')"
    when = [f"WHEN {_marked(incoming)} OR {_marked(reply)} THEN {{'label': {literal(L.EVERYDAY)}, 'action': ''}}"]
    when += [f"WHEN regexp_matches({incoming}, {literal(a)}) AND regexp_matches({reply}, {literal(b)}) THEN {{'label': {literal(n)}, 'action': {literal(act)}}}" for n, a, b, act in situations]
    return f"lab AS (SELECT * EXCLUDE (s), s.label AS label, s.action AS action FROM (SELECT *, CASE {' '.join(when)} ELSE {{'label': {literal(L.EVERYDAY)}, 'action': ''}} END AS s FROM {of}))"


def signals_sql(most: int = 6) -> str:
    stop = ", ".join(map(literal, L.SIGNAL_STOP))
    return f"""sg AS (SELECT conv_id, label, list(token ORDER BY rank) AS signals FROM (SELECT conv_id, label, token, row_number() OVER (PARTITION BY conv_id, label ORDER BY count(*) DESC, token) AS rank FROM (
        SELECT conv_id, label, unnest(regexp_extract_all(array_to_string(incoming, ' '), {literal(L.SIGNAL_TOKEN)})) AS token FROM lab WHERE action <> '') WHERE token NOT IN ({stop}) GROUP BY 1, 2, 3 QUALIFY rank <= {most}) GROUP BY 1, 2)"""


def scenarios_sql(situations) -> str:
    """CTEs that end in scen, from lab."""
    pattern = lambda k: "CASE label " + " ".join(f"WHEN {literal(s[0])} THEN {literal(s[k])}" for s in situations) + " END"
    ids = "CASE label " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in L.SCENARIO_IDS.items()) + " ELSE 'scenario' END"
    return f"""act AS (SELECT * FROM lab WHERE action <> ''), {picks_sql('act', ('conv_id', 'label'), 3)}, {signals_sql()},
    gr AS (SELECT conv_id, label, any_value(action) AS response_move, count(DISTINCT session_id) AS sessions, row_number() OVER (PARTITION BY conv_id ORDER BY count(DISTINCT session_id) DESC, label) AS rank FROM act GROUP BY 1, 2 QUALIFY rank <= 12),
    eg AS (SELECT conv_id, label, count(*) AS examples, string_agg(concat(array_to_string(incoming, '|'), ' > ', array_to_string(reply, '|'), ' ', pairing), ';' ORDER BY rank) AS shown FROM picked GROUP BY 1, 2),
    scen AS (SELECT conv_id, {ids} AS id, label, coalesce(signals, []) AS signals, {pattern(1)} AS trigger_pattern, {pattern(2)} AS reply_pattern, response_move, examples, shown,
        CASE WHEN sessions > 1 THEN 'repeated_observation' ELSE 'single_observation' END AS confidence, sessions, rank FROM gr JOIN eg USING (conv_id, label) LEFT JOIN sg USING (conv_id, label))"""


ZH_PAIRS = f"""zh_s2 AS (SELECT * FROM ch_r WHERE conv_id = 'zh'), zh_sides AS (SELECT * FROM sides WHERE conv_id = 'zh'), {pairs_sql('zh_s2', 'zh_sides', 80)}"""
SHOWN_PAIR = "conv_id, session_id, array_to_string(incoming, '|') AS incoming, array_to_string(reply, '|') AS reply, array_to_string(incoming_messages, '|') AS incoming_messages, array_to_string(reply_messages, '|') AS reply_messages, pairing"


def shown_pairs(p):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "|").alias(c)
    return p.select("conv_id", "session_id", *(joined(c) for c in ("incoming", "reply", "incoming_messages", "reply_messages")), "pairing")


def shown_scenarios(p):
    shown = F.array_join(F.transform("examples", lambda x: F.concat(F.array_join(x["incoming"], "|"), F.lit(" > "), F.array_join(x["reply"], "|"), F.lit(" "), x["pairing"])), ";")
    return p.withColumns({"shown": shown, "signals": F.array_join("signals", "|"), "examples": F.size("examples").cast("long")})


SCENARIO_COLUMNS = "* REPLACE (array_to_string(signals, '|') AS signals)"


def pairs(spark, sf):
    return E.exchanges(chats(spark, sf), chat_sides(spark, sf), most_chars=MOST)


def zh_pairs(spark):
    return E.classified(E.exchanges(zh(spark), sides(spark)))


@query(f"WITH {ADJACENT} SELECT conv_id, session_id, array_to_string(incoming, '|') AS incoming, array_to_string(reply, '|') AS reply, incoming_messages[1] AS first_incoming, reply_messages[1] AS first_reply FROM adj")
def j02_adjacent_pairs(spark, sf):
    p = E.adjacent(chats(spark, sf), chat_sides(spark, sf), most_chars=MOST)
    return p.select("conv_id", "session_id", F.array_join("incoming", "|").alias("incoming"), F.array_join("reply", "|").alias("reply"), F.get("incoming_messages", F.lit(0)).alias("first_incoming"), F.get("reply_messages", F.lit(0)).alias("first_reply"))


REPLIES = "rp AS (SELECT * REPLACE (CAST(seq AS VARCHAR) AS source_id, CASE WHEN seq % 2 = 0 THEN CAST(seq - 1 AS VARCHAR) ELSE '' END AS reply_to) FROM cv)"


@query(f"""WITH {REPLIES}, u AS (SELECT conv_id, source_id, any_value(seq) AS s_seq, any_value(speaker) AS s_speaker, any_value(text) AS s_text, any_value(reply_to) AS s_reply FROM rp WHERE source_id <> '' GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT m.conv_id, s_text AS incoming, m.text AS reply, s_seq AS first_incoming, m.seq AS first_reply FROM rp m JOIN u ON u.conv_id = m.conv_id AND u.source_id = m.reply_to
    WHERE m.reply_to <> '' AND m.speaker = 'assistant' AND s_speaker = 'user' AND s_seq < m.seq AND s_reply = '' AND length(s_text) <= 2000 AND length(m.text) <= 2000""")
def j01_explicit_replies(spark, sf):
    m = cv(spark, sf).withColumns({"source_id": F.col("seq").cast("string"), "reply_to": F.when(F.col("seq") % 2 == 0, (F.col("seq") - 1).cast("string")).otherwise("")})
    p = E.explicit(m, chat_sides(spark, sf), most_chars=2000)
    return p.select("conv_id", F.get("incoming", F.lit(0)).alias("incoming"), F.get("reply", F.lit(0)).alias("reply"), F.get("incoming_messages", F.lit(0)).alias("first_incoming"), F.get("reply_messages", F.lit(0)).alias("first_reply"))


@query(f"WITH {pairs_sql('ch_r', 'sides', MOST)} SELECT {SHOWN_PAIR} FROM prs")
def q01_exchanges(spark, sf):
    return shown_pairs(pairs(spark, sf))


@query(f"WITH {ZH_PAIRS} SELECT {SHOWN_PAIR} FROM prs")
def q01_exchanges_zh(spark, sf):
    return shown_pairs(E.exchanges(zh(spark), sides(spark)))


def _label_sql(incoming: str, reply: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({incoming}, {literal(left)}) AND regexp_matches({reply}, {literal(right)}) THEN {literal(label)}" for label, left, right, _ in L.SITUATIONS) + f" ELSE {literal(L.EVERYDAY)} END"


ALTERNATE = (("question", r"que|what|wer", r"the|la|der", "answer"), ("short", r"^.{0,120}$", r"^.{0,300}$", "short answer"))


@query(f"WITH {ADJACENT} SELECT conv_id, reply_messages[1] AS first_reply, {_label_sql('array_to_string(incoming, chr(32))', 'array_to_string(reply, chr(32))')} AS label FROM adj")
def q02_situations(spark, sf):
    p = E.classified(E.adjacent(chats(spark, sf), chat_sides(spark, sf), most_chars=MOST))
    return p.select("conv_id", F.get("reply_messages", F.lit(0)).alias("first_reply"), "label")


@query("SELECT conv_id, seq, " + "CASE WHEN " + " + ".join(f"CAST(regexp_matches(text, {literal(left)}) AS INTEGER)" for _, left, _, _ in L.SITUATIONS) + " = 1 THEN CASE " + " ".join(f"WHEN regexp_matches(text, {literal(left)}) THEN {literal(label)}" for label, left, _, _ in L.SITUATIONS) + " END END AS label FROM chats")
def q03_input_situation(spark, sf):
    return chats(spark, sf).select("conv_id", "seq", E.input_situation(F.col("text")).alias("label"))


ALTERNATE_LAB = f"{pairs_sql('ch_r', 'sides', MOST)}, {labelled_sql('prs', ALTERNATE)}"
ZH_LAB = f"{ZH_PAIRS}, {labelled_sql('prs', L.SITUATIONS)}"


def alternate_pairs(spark, sf):
    return E.classified(pairs(spark, sf), ALTERNATE)


ALT = f"""{ADJACENT}, lab AS (SELECT *, CASE WHEN regexp_matches(array_to_string(incoming, ' '), 'que|what|wer') AND regexp_matches(array_to_string(reply, ' '), 'the|la|der') THEN 'question' WHEN length(array_to_string(incoming, ' ')) <= 120 AND NOT contains(array_to_string(incoming, ' '), chr(10)) AND length(array_to_string(reply, ' ')) <= 300 AND NOT contains(array_to_string(reply, ' '), chr(10)) THEN 'short' ELSE '' END AS label FROM adj)"""


@query(f"""WITH {ALT}, g AS (SELECT conv_id, label, count(DISTINCT session_id) AS sessions, count(*) AS pairs, min(reply_messages[1]) AS first FROM lab WHERE label <> '' GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sessions DESC, first) AS rank FROM g""")
def t11_ranked_situations(spark, sf):
    p = E.classified(E.adjacent(chats(spark, sf), chat_sides(spark, sf), most_chars=MOST), ALTERNATE)
    return E.ranked_situations(p)


@query(f"WITH {ALTERNATE_LAB}, {picks_sql('lab', ('conv_id',), 3)} SELECT conv_id, session_id, array_to_string(incoming, '|') AS incoming, array_to_string(reply, '|') AS reply, label, rank FROM picked")
def t03_selected(spark, sf):
    return E.selected(alternate_pairs(spark, sf), 3).select("conv_id", "session_id", F.array_join("incoming", "|").alias("incoming"), F.array_join("reply", "|").alias("reply"), "label", "rank")


@query(f"WITH {ALTERNATE_LAB}, {signals_sql()} SELECT conv_id, label, array_to_string(signals, '|') AS signals FROM sg")
def a26_signals(spark, sf):
    return E.signals(alternate_pairs(spark, sf)).withColumn("signals", F.array_join("signals", "|"))


@query(f"WITH {ALTERNATE_LAB}, {scenarios_sql(ALTERNATE)} SELECT {SCENARIO_COLUMNS} FROM scen")
def q05_scenarios(spark, sf):
    return shown_scenarios(E.scenarios(alternate_pairs(spark, sf), situations=ALTERNATE))


@query(f"WITH {ZH_LAB}, {scenarios_sql(L.SITUATIONS)} SELECT {SCENARIO_COLUMNS} FROM scen")
def q05_scenarios_zh(spark, sf):
    return shown_scenarios(E.scenarios(zh_pairs(spark)))


CURRENT = "CASE label " + " ".join(f"WHEN {literal(s[0])} THEN regexp_matches(text, {literal(s[1])})" for s in ALTERNATE) + " ELSE true END"


@query(f"""WITH {ALTERNATE_LAB}, {scenarios_sql(ALTERNATE)},
    hits AS (SELECT c.conv_id, seq AS id, s.id AS scenario, label, response_move, rank, {CURRENT} AS fits,
        coalesce(list_sum(list_transform(list_filter(signals, lambda x: contains(text, x)), lambda x: length(x))), 0) + CASE WHEN trigger_pattern <> '' AND regexp_matches(text, trigger_pattern) THEN 2 ELSE 0 END AS score
        FROM cv c JOIN scen s ON s.conv_id = c.conv_id WHERE speaker = 'user' AND NOT regexp_matches(text, {literal(L.DISTRESS)}))
    SELECT conv_id, id, scenario, label, response_move, score FROM hits WHERE fits AND score > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, id ORDER BY score DESC, rank) = 1""")
def q06_routes(spark, sf):
    routes = E.scenarios(alternate_pairs(spark, sf), situations=ALTERNATE)
    inputs = cv(spark, sf).where("speaker = 'user'").select("conv_id", F.col("seq").alias("id"), "text")
    return E.routed(inputs, routes, ALTERNATE)


def coverage_sql(lab: str, of: str, sides_: str, situations) -> str:
    said = " UNION ALL ".join(f"SELECT m.conv_id, {literal(s[0])} AS label FROM {of} m JOIN {sides_} d ON d.conv_id = m.conv_id AND m.speaker = d.counterpart WHERE regexp_matches(m.text, {literal(s[1])})" for s in situations)
    grid = ", ".join(f"({k}, {literal(s[0])})" for k, s in enumerate(situations))
    return f"""WITH {lab}, {scenarios_sql(situations)}, inp AS (SELECT conv_id, label, count(*) AS observed_inputs FROM ({said}) GROUP BY 1, 2), names(place, label) AS (VALUES {grid})
    SELECT d.conv_id, place, n.label, CASE WHEN coalesce(examples, 0) = 0 THEN CASE WHEN coalesce(observed_inputs, 0) > 0 OR sessions IS NOT NULL THEN 'missing_response' ELSE 'evidence_insufficient' END WHEN sessions < 2 THEN 'evidence_insufficient' ELSE 'covered' END AS status,
        coalesce(sessions, 0) AS sessions, coalesce(examples, 0) AS examples, coalesce(observed_inputs, 0) AS observed_inputs, coalesce(response_move, '') AS response_move
    FROM {sides_} d CROSS JOIN names n LEFT JOIN scen s ON s.conv_id = d.conv_id AND s.label = n.label LEFT JOIN inp i ON i.conv_id = d.conv_id AND i.label = n.label"""


@query(coverage_sql(ZH_LAB, "zh_s2", "zh_sides", L.SITUATIONS))
def a23_coverage(spark, sf):
    m = zh(spark)
    return E.coverage(zh_pairs(spark), E.scenarios(zh_pairs(spark)), m, sides(spark))


@query(coverage_sql(ALTERNATE_LAB, "chats", "sides", ALTERNATE))
def a23_coverage_whole(spark, sf):
    p = alternate_pairs(spark, sf)
    return E.coverage(p, E.scenarios(p, situations=ALTERNATE), chats(spark, sf), chat_sides(spark, sf), ALTERNATE)


@query(f"WITH {ZH_LAB}, {picks_sql('lab', ('conv_id',), 8)} SELECT conv_id, rank, concat('对方：「', array_to_string(incoming, '」「'), '」 → 我：「', array_to_string(reply, '」「'), '」') AS shown FROM picked")
def t14_demonstrations(spark, sf):
    return E.demonstrations(zh_pairs(spark))


@query("""WITH t AS (SELECT conv_id, turn, role, text, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last_user FROM conversations WHERE trim(text) <> '')
    SELECT conv_id, turn, role, text FROM t WHERE turn <= last_user QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20""")
def q18_chat_turns(spark, sf):
    """The last 20 turns up to the last one of a user."""
    return E.chat_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "text")


@query(f"SELECT seq, {MARK} AS marked, trim(regexp_replace(text, {literal(L.UNRESOLVED_REPLY)}, '', 'g')) AS said FROM zh")
def p06_unresolved_replies(spark, sf):
    return zh(spark).select("seq", X.has_unresolved_reply("text").alias("marked"), X.reply_text("text").alias("said"))


@query("""WITH d AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, coalesce(n, 0) AS german FROM (SELECT DISTINCT source FROM documents) LEFT JOIN (SELECT source, n FROM d WHERE lang = 'de') USING (source)""")
def j08_left_lookup(spark, sf):
    d = dv(spark, sf)
    by = d.where("speaker = 'de'").groupBy("conv_id").agg(F.count("*").alias("n"))
    return E.looked_up(d.select("conv_id").distinct(), by, "conv_id", {"n": F.lit(0)}).select(F.col("conv_id").alias("source"), F.col("n").alias("german"))
