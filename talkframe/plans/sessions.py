"""Queries over sessions, runs, gaps and the message index."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.operators import sessions as S
from talkframe.operators.messages import with_ordinals
from talkframe.plans.base import chats, cv, dv, ev, query

KEY = "sha256(CASE WHEN ts IS NULL THEN '' WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || chr(10) || speaker || chr(10) || text)"


@query("SELECT conv_id, seq, session_id FROM ev_s")
def w01_sessions(spark, sf):
    return S.with_sessions(ev(spark, sf)).select("conv_id", "seq", "session_id")


@query("SELECT conv_id, seq, session_id FROM ch_s")
def w01_sessions_untimed(spark, sf):
    return S.with_sessions(chats(spark, sf)).select("conv_id", "seq", "session_id")


@query("SELECT conv_id, session_id, run_id, min(speaker) AS speaker, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM ev_r GROUP BY conv_id, session_id, run_id")
def w02_runs(spark, sf):
    return S.with_runs(ev(spark, sf)).groupBy("conv_id", "session_id", "run_id").agg(F.min("speaker").alias("speaker"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


@query("""SELECT conv_id, seq, coalesce(ps = speaker AND (pt IS NULL OR ts IS NULL OR epoch_us(ts) - epoch_us(pt) BETWEEN 0 AND 1800000000), false) AS burst
    FROM (SELECT *, lag(speaker) OVER w AS ps, lag(ts) OVER w AS pt FROM ev WINDOW w AS (PARTITION BY conv_id ORDER BY seq))""")
def w03_bursts(spark, sf):
    return S.with_burst(ev(spark, sf)).select("conv_id", "seq", "burst")


@query("""SELECT conv_id, session_id, arg_min(speaker, seq) AS starter, count(*) AS n FROM ch_s GROUP BY conv_id, session_id HAVING count(ts) > 0""")
def w04_starters(spark, sf):
    return S.starters(chats(spark, sf))


@query("""SELECT conv_id, session_id, arg_max(speaker, seq) AS closer FROM ch_s WHERE trim(text) <> '' GROUP BY conv_id, session_id""")
def w04_closers(spark, sf):
    return S.closers(S.with_sessions(chats(spark, sf)))


@query("""SELECT conv_id, session_id, run_id, min(speaker) AS speaker, string_agg(text, '|' ORDER BY seq) AS said, count(*) AS n FROM ch_r GROUP BY conv_id, session_id, run_id""")
def w05_run_messages(spark, sf):
    return S.runs(chats(spark, sf)).select("conv_id", "session_id", "run_id", "speaker", F.array_join("lines", "|").alias("said"), "n")


@query("""SELECT conv_id, ts AS since, nx AS until, CAST(floor((epoch_us(nx) - epoch_us(ts)) / 86400e6) AS BIGINT) AS days FROM (SELECT *, lead(ts) OVER (PARTITION BY conv_id ORDER BY ts, seq) AS nx FROM chats WHERE ts IS NOT NULL)
    WHERE floor((epoch_us(nx) - epoch_us(ts)) / 86400e6) >= 1""")
def w06_silences(spark, sf):
    return S.silences(chats(spark, sf), days=1)


@query("""WITH l AS (SELECT conv_id, seq, trim(x) AS line, row_number() OVER () AS r, pos FROM (SELECT conv_id, seq, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM (SELECT * REPLACE (regexp_replace(text, '\\[[^\\[\\]]{0,24}\\]', ' ', 'g') AS text) FROM cv)) WHERE trim(x) <> '')
    SELECT conv_id, seq, line, lag(line) OVER w AS before, lead(line) OVER w AS after FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY seq, pos)""")
def w07_neighbours(spark, sf):
    return S.neighbours(cv(spark, sf)).select("conv_id", "seq", "line", "before", "after")


@query(f"""SELECT conv_id, seq AS "index", substr(sha256(CAST(seq AS VARCHAR) || chr(10) || CASE WHEN ts IS NULL THEN '' WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || chr(10) || speaker || chr(10) || text), 1, 16) AS id,
    {KEY} AS key, strftime(ts, '%Y-%m-%d') AS date, session_id + 1 AS session FROM ev_s""")
def w08_message_index(spark, sf):
    return S.message_index(ev(spark, sf)).select("conv_id", "index", "id", "key", "date", "session")


@query("SELECT conv_id, seq, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY seq) AS ordinal FROM dv")
def w09_ordinals(spark, sf):
    return with_ordinals(dv(spark, sf), ["conv_id", "speaker"]).select("conv_id", "seq", "ordinal")


@query("""SELECT conv_id, count(*) AS sessions, max(n) AS longest FROM (SELECT conv_id, session_id, count(*) AS n FROM ev_s GROUP BY 1, 2) GROUP BY conv_id""")
def r05_session_windows(spark, sf):
    timed = ev(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    # an inclusive gap: sessions join where they touch
    w = timed.groupBy("conv_id", F.session_window("at", "1800001 milliseconds")).agg(F.count("*").alias("n"))
    return w.groupBy("conv_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("""SELECT conv_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS timed, count(DISTINCT strftime(ts, '%Y-%m')) AS months, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6) AS BIGINT) + 1 AS span_days, any_value(gaps) AS gaps, any_value(longest) AS longest_gap
    FROM ev JOIN (SELECT conv_id, count(*) FILTER (g >= 2) AS gaps, max(g) FILTER (g >= 2) AS longest FROM (SELECT conv_id, date_diff('day', d, lead(d) OVER (PARTITION BY conv_id ORDER BY d)) AS g FROM (SELECT DISTINCT conv_id, CAST(ts AS DATE) AS d FROM ev)) GROUP BY conv_id) USING (conv_id) GROUP BY conv_id""")
def a11_timeline(spark, sf):
    return S.timeline(ev(spark, sf), days=2)


@query("""SELECT * FROM (SELECT conv_id, strftime(ts, '%Y-%m') AS month, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, strftime(ts, '%Y-%m')) AS rank FROM chats WHERE ts IS NOT NULL GROUP BY 1, 2
    QUALIFY count(*) OVER (PARTITION BY conv_id) >= 3) WHERE rank <= 3""")
def a11_busiest_months(spark, sf):
    return S.busiest_months(chats(spark, sf))


@query("SELECT conv_id, min(strftime(ts, '%Y-%m')) || ' ~ ' || max(strftime(ts, '%Y-%m')) AS span FROM ev GROUP BY conv_id")
def a32_month_span(spark, sf):
    from talkframe.operators.evidence import month_span

    return month_span(ev(spark, sf))


@query("""SELECT conv_id, seq, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hour FROM ev""")
def d01_date_parts(spark, sf):
    return ev(spark, sf).select("conv_id", "seq", F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.hour("ts").alias("hour"))


@query("""SELECT conv_id, seq, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60e6 AS minutes FROM ev WINDOW w AS (PARTITION BY conv_id ORDER BY seq)""")
def d02_minutes_since(spark, sf):
    return S.with_previous(ev(spark, sf), before="ts").select("conv_id", "seq", S.minutes_between(F.col("ts"), F.col("before")).alias("minutes"))


@query(f"SELECT conv_id, seq, {KEY} AS key FROM chats")
def x10_content_keys(spark, sf):
    return chats(spark, sf).select("conv_id", "seq", X.content_key("ts", "speaker", "text").alias("key"))
