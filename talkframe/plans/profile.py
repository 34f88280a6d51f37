"""Queries over speaker profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators import profile as P
from talkframe.operators import sessions as S
from talkframe.plans.base import any_like, chats, ev, literal, query, words_re

Q_END = "regexp_matches(text, '(\\?|？|吗|呢|吧)\\s*$')"
EMOJI = "regexp_extract_all(text, '\\[[^\\[\\]]{1,8}\\]')"
MEDIA24 = "regexp_matches(text, '^(\\s*\\[[^\\[\\]]{0,24}\\]\\s*)+$')"

def pct(part: str, whole: str, digits: int = 1) -> str:
    return f"CASE WHEN {whole} > 0 THEN round_even(CAST({part} AS DOUBLE) / {whole} * 100, {digits}) ELSE 0.0 END"


def _profile_sql(ses: str, gaps: str) -> str:
    return f"""WITH b AS (SELECT *, coalesce(lag(speaker) OVER w = speaker AND (lag(ts) OVER w IS NULL OR ts IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) BETWEEN 0 AND 1800000000), false) AS burst FROM {ses} WINDOW w AS (PARTITION BY conv_id ORDER BY seq)),
    base AS (SELECT conv_id, speaker, count(*) AS messages, min(ts) AS first_ts, max(ts) AS last_ts, count(ts) AS timed, count(*) FILTER (hour(ts) >= 23 OR hour(ts) <= 5) AS late_night, sum(length(text)) AS chars,
        count(*) FILTER (burst) AS bursts, count(*) FILTER ({Q_END}) AS questions, count(*) FILTER (len({EMOJI}) > 0) AS with_emoji FROM b GROUP BY 1, 2),
    g AS (SELECT conv_id, speaker, round_even(median(gap), 1) AS reply_gap FROM {gaps} GROUP BY 1, 2),
    st AS (SELECT conv_id, starter AS speaker, count(*) AS sessions_started FROM (SELECT conv_id, session_id, arg_min(speaker, seq) AS starter FROM {ses} GROUP BY 1, 2 HAVING count(ts) > 0) GROUP BY 1, 2)
    SELECT conv_id, speaker, messages, first_ts, last_ts, timed, late_night, round_even(chars / messages, 1) AS avg_len, {pct("bursts", "messages")} AS burst_ratio, {pct("questions", "messages")} AS question_ratio,
        {pct("with_emoji", "messages")} AS emoji_ratio, coalesce(reply_gap, 0.0) AS reply_gap, coalesce(sessions_started, 0) AS sessions_started FROM base LEFT JOIN g USING (conv_id, speaker) LEFT JOIN st USING (conv_id, speaker)"""


@query(_profile_sql("ch_s", "ch_g"))
def a01_speaker_profile(spark, sf):
    return P.speaker_profile(chats(spark, sf))


@query(_profile_sql("ev_s", "ev_g"))
def a01_speaker_profile_events(spark, sf):
    return P.speaker_profile(ev(spark, sf))


PER = "p AS (SELECT conv_id, speaker, count(*) AS n, min(seq) AS first_seq FROM {m} GROUP BY 1, 2)"


@query("SELECT conv_id, speaker, count(*) AS n, min(seq) AS first_seq FROM ev GROUP BY 1, 2")
def a02_per_speaker(spark, sf):
    return P.per_speaker(ev(spark, sf))


@query(f"WITH {PER.format(m='ev')} SELECT conv_id, speaker AS target FROM p WHERE speaker <> 'view' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first_seq) = 1")
def a02_targets(spark, sf):
    return P.targets(ev(spark, sf), me=("view",))


@query(f"""WITH {PER.format(m='ev')}, t AS (SELECT conv_id, speaker AS target FROM p WHERE speaker <> 'view' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first_seq) = 1)
    SELECT conv_id, target, speaker AS counterpart FROM p JOIN t USING (conv_id) WHERE speaker <> target AND speaker <> 'error' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first_seq) = 1""")
def a03_counterparts(spark, sf):
    m = ev(spark, sf)
    return P.counterparts(m, P.targets(m, me=("view",)), ignore=("error",))


@query("SELECT conv_id, seq, speaker, gap FROM ev_g")
def a04_reply_gaps(spark, sf):
    return S.reply_gaps(ev(spark, sf))


@query("""SELECT conv_id, speaker, count(*) AS gaps, median(gap) AS median_gap, list_sort(list(gap))[1 + CAST(round_even(0.9 * (count(*) - 1), 0) AS BIGINT)] AS high_gap FROM ev_g GROUP BY 1, 2""")
def a05_gap_percentiles(spark, sf):
    return P.gap_summary(ev(spark, sf))


@query("SELECT conv_id, speaker, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def a06_hours(spark, sf):
    return P.hours(ev(spark, sf))


@query(f"SELECT conv_id, speaker, e AS emoji, count(*) AS n FROM (SELECT conv_id, speaker, unnest({EMOJI}) AS e FROM chats) GROUP BY 1, 2, 3")
def a06_emoji(spark, sf):
    return P.emoji_counts(chats(spark, sf))


@query(f"SELECT conv_id, speaker, w AS word, count(*) AS n FROM chats, (SELECT unnest([{', '.join(map(literal, (*L.CONFLICT_WORDS, 'pas', 'nicht')))}]) AS w) WHERE contains(text, w) GROUP BY 1, 2, 3")
def a06_conflict_words(spark, sf):
    return P.word_messages(chats(spark, sf), (*L.CONFLICT_WORDS, "pas", "nicht"))


@query(f"""SELECT conv_id, speaker, phrase, count(*) AS n FROM (SELECT conv_id, speaker, trim(unnest(regexp_split_to_array(text, '[。！？!?~～\\.,，、\\s]+'))) AS phrase FROM chats)
    WHERE NOT contains(phrase, '[') AND NOT contains(phrase, ']') AND length(phrase) BETWEEN 2 AND 8 AND phrase NOT IN ({', '.join(map(literal, (*L.STOP_PHRASES, 'the', 'of')))}) AND NOT regexp_matches(phrase, '^[0-9]+$') GROUP BY 1, 2, 3""")
def a06_phrases(spark, sf):
    return P.phrase_counts(chats(spark, sf), (*L.STOP_PHRASES, "the", "of"))


def _occurrences(column: str, word: str) -> str:
    return f"(length({column}) - length(replace({column}, {literal(word)}, ''))) // {len(word)}"


@query("SELECT conv_id, speaker, word, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT conv_id, speaker, {literal(w)} AS word, {_occurrences('text', w)} AS n FROM chats" for w in (*L.TONE_PARTICLES, "on", "er")) + ") WHERE n > 0 GROUP BY 1, 2, 3")
def a07_tone_words(spark, sf):
    return P.word_counts(chats(spark, sf), (*L.TONE_PARTICLES, "on", "er"))


@query()
def a07_tone_undoubled(spark, sf):
    return P.word_counts(chats(spark, sf), L.TONE_PARTICLES, undouble=True)


@query()
def a07_laughs(spark, sf):
    return P.laugh_counts(chats(spark, sf), (*L.LAUGH_WORDS, "ha"))


END = "regexp_matches(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '({})$')"


@query(f"""WITH r AS (SELECT *, coalesce(lag(speaker) OVER (PARTITION BY conv_id ORDER BY seq) = speaker, false) AS again FROM chats), a AS (SELECT conv_id, speaker, count(*) FILTER (again) AS bursts FROM r GROUP BY 1, 2)
    SELECT conv_id, speaker, count(*) AS messages, median(length(text)) AS median_len, round_even(avg(length(text)), 1) AS avg_len, {pct("count(*) FILTER (length(text) <= 8)", "count(*)", 0)} AS short_pct, {pct("count(*) FILTER (length(text) >= 40)", "count(*)", 0)} AS long_pct,
    {pct("count(*) FILTER (NOT " + END.format("[。！？!?…~～]") + ")", "count(*)", 0)} AS no_end_pct, {pct("count(*) FILTER (" + END.format("。") + ")", "count(*)", 0)} AS period_pct, {pct("count(*) FILTER (" + END.format("[~～]") + ")", "count(*)", 0)} AS wave_pct,
    {pct("count(*) FILTER (" + END.format("[！!]") + ")", "count(*)", 0)} AS mark_pct, {pct("count(*) FILTER (" + Q_END + ")", "count(*)", 0)} AS question_pct, {pct("count(*) FILTER (" + END.format("！|!|哈哈|啦") + ")", "count(*)", 0)} AS exclaim_pct,
    {pct("count(*) FILTER (contains(text, chr(10)))", "count(*)", 0)} AS multi_line_pct, any_value(bursts) AS bursts FROM r JOIN a USING (conv_id, speaker) WHERE trim(text) <> '' GROUP BY 1, 2""")
def a08_style(spark, sf):
    return P.style(chats(spark, sf))


MOOD = {
    "positive": (*L.POSITIVE_WORDS, "with", "ist"), "negative": (*L.NEGATIVE_WORDS, "pas", "nicht"), "care": (*L.CARE_WORDS, "for"), "conflict": (*L.CONFLICT_WORDS, "pas"),
    "laugh": (*L.LAUGH_WORDS, "haha"), "low": (*L.LOW_MOOD_WORDS, "un "), "direct": (*L.SAID_DIRECTLY, "you"),
}


def _count(words) -> str:
    return f"len(regexp_extract_all(text, {words_re(words)}))"


@query(f"""WITH r AS (SELECT conv_id, speaker, {_count(MOOD["positive"])} AS pos, {_count(MOOD["negative"])} AS neg, {_count(MOOD["care"])} AS care, {any_like("text", MOOD["conflict"])} AND NOT {MEDIA24} AS conflict, {_count(MOOD["laugh"])} > 0 AND NOT {MEDIA24} AS laugh,
    {any_like("text", MOOD["low"])} AND NOT {MEDIA24} AS low, {any_like("text", MOOD["direct"])} AND NOT {MEDIA24} AS direct FROM chats WHERE trim(text) <> '')
    SELECT *, CASE WHEN positive + negative > 0 THEN CASE WHEN 100 * positive / (positive + negative) >= 65 THEN 'warm' WHEN 100 * positive / (positive + negative) <= 40 THEN 'cool' ELSE 'even' END END AS tone FROM (
    SELECT conv_id, speaker, count(*) AS messages, CAST(sum(pos) AS BIGINT) AS positive, CAST(sum(neg) AS BIGINT) AS negative, CAST(sum(care) AS BIGINT) AS care, count(*) FILTER (pos > 0) AS positive_messages, count(*) FILTER (neg > 0) AS negative_messages,
    count(*) FILTER (r.care > 0) AS care_messages, count(*) FILTER (conflict) AS conflict_messages, count(*) FILTER (laugh) AS laugh_messages, count(*) FILTER (low AND pos = 0) AS low_messages, count(*) FILTER (direct) AS direct_messages FROM r GROUP BY 1, 2)""")
def a09_mood(spark, sf):
    return P.mood(chats(spark, sf), **MOOD)


@query("""WITH base AS (SELECT conv_id, speaker, count(*) AS messages, round_even(avg(length(text)) FILTER (trim(text) <> ''), 1) AS avg_len FROM ev GROUP BY 1, 2),
    g AS (SELECT conv_id, speaker, round_even(median(gap), 4) AS median_gap, round_even(list_sort(list(gap))[1 + CAST(round_even(0.9 * (count(*) - 1), 0) AS BIGINT)], 4) AS high_gap FROM ev_g GROUP BY 1, 2),
    b AS (SELECT conv_id, starter AS speaker, count(*) AS began FROM (SELECT conv_id, session_id, arg_min(speaker, seq) AS starter FROM ev_s GROUP BY 1, 2 HAVING count(ts) > 0) GROUP BY 1, 2),
    c AS (SELECT conv_id, closer AS speaker, count(*) AS closed FROM (SELECT conv_id, session_id, arg_max(speaker, seq) AS closer FROM ev_s WHERE trim(text) <> '' GROUP BY 1, 2) GROUP BY 1, 2)
    SELECT conv_id, speaker, messages, avg_len, round_even(messages / sum(messages) OVER (PARTITION BY conv_id) * 100, 0) AS share_pct, coalesce(began, 0) AS began, coalesce(closed, 0) AS closed, median_gap, high_gap
    FROM base LEFT JOIN g USING (conv_id, speaker) LEFT JOIN b USING (conv_id, speaker) LEFT JOIN c USING (conv_id, speaker)""")
def a10_relation_metrics(spark, sf):
    return P.relation_metrics(ev(spark, sf))


PETS, DIRECT, CARE = (*L.PET_NAMES, "elle"), (*L.DIRECT_WORDS, "you"), (*L.CARE_WORDS, "for")


@query(f"""WITH w AS (SELECT conv_id, speaker, count(*) AS messages, count(*) FILTER ({any_like("text", CARE)}) AS care, count(*) FILTER ({any_like("text", PETS)}) AS pets, count(*) FILTER ({any_like("text", DIRECT)}) AS direct,
    count(*) FILTER (contains(text, '[表情]') OR contains(text, '[动画表情]') OR len(list_filter({EMOJI}, lambda e: NOT regexp_full_match(e, {literal(L.MEDIA_PLACEHOLDER)}))) > 0) AS emoji FROM chats WHERE trim(text) <> '' GROUP BY 1, 2)
    SELECT *, CASE WHEN greatest(care, pets, direct, emoji) = 0 THEN NULL WHEN care = greatest(care, pets, direct, emoji) THEN 'care' WHEN pets = greatest(pets, direct, emoji) THEN 'pets' WHEN direct = greatest(direct, emoji) THEN 'direct' ELSE 'emoji' END AS carrier,
    array_to_string(list_filter([CASE WHEN care = 0 THEN 'care' END, CASE WHEN pets = 0 THEN 'pets' END, CASE WHEN direct = 0 THEN 'direct' END, CASE WHEN emoji = 0 THEN 'emoji' END], lambda x: x IS NOT NULL), ',') AS missing FROM w""")
def a12_warmth(spark, sf):
    return P.warmth(chats(spark, sf), CARE, PETS, DIRECT)


SIGNALS = {**L.RELATION_SIGNALS, "plain": ("the", "the", "la", "und")}


def _density(name: str, words) -> str:
    return f"SELECT conv_id, speaker, {list(SIGNALS).index(name)} AS place, {literal(name)} AS relation, sum({' + '.join(_occurrences('text', w) for w in words)}) / greatest(sum(length(text)), 1) * 1000 AS density FROM chats WHERE trim(text) <> '' GROUP BY 1, 2"


@query("WITH d AS (" + " UNION ALL ".join(_density(k, v) for k, v in SIGNALS.items()) + """) SELECT conv_id, speaker, CASE WHEN density < 1.0 THEN '朋友' ELSE relation END AS relation, round_even(density, 4) AS density FROM d
    QUALIFY row_number() OVER (PARTITION BY conv_id, speaker ORDER BY density DESC, place) = 1""")
def a13_relation(spark, sf):
    return P.relation(chats(spark, sf), SIGNALS)


@query()
def a31_style_rules(spark, sf):
    return P.style_rules(chats(spark, sf))


@query(f"SELECT conv_id, seq, {Q_END} AS question, coalesce(hour(ts) >= 23 OR hour(ts) <= 5, false) AS late, regexp_matches(text, '^(\\s*\\[[^\\[\\]]*\\]\\s*)+$') AS media FROM chats")
def p04_predicates(spark, sf):
    h = F.hour("ts")
    return chats(spark, sf).select("conv_id", "seq", X.is_question("text").alias("question"), F.coalesce((h >= 23) | (h <= 5), F.lit(False)).alias("late"), X.is_media_only("text").alias("media"))


@query("SELECT conv_id, speaker, CAST(sum(CASE WHEN session_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS even_sessions, count(DISTINCT session_id) AS sessions FROM ev_s GROUP BY 1, 2")
def a18_session_spread(spark, sf):
    s = S.with_sessions(ev(spark, sf))
    return s.groupBy("conv_id", "speaker").agg(F.count_if(F.col("session_id") % 2 == 0).alias("even_sessions"), F.count_distinct("session_id").alias("sessions"))

