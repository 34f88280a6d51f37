"""Sessions, runs, gaps and the message index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators import scans


def minutes_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 60e6


_CONV = ["conv_id"]


def with_sessions(m: DataFrame, gap_minutes: int = L.SESSION_GAP_MINUTES, size: int = scans.SEGMENT) -> DataFrame:
    """session_id from 0: a new one where a timed message goes back, or is more than the gap after the last timed one.

    size: numbers of seq that a segment spans; a conversation may have any number of them.
    """
    rows = scans.cut(m, scans.by_number(size=size))
    opens = lambda ts, last: F.coalesce((ts < last) | (minutes_between(ts, last) > gap_minutes), F.lit(False))
    preceding = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    local = preceding(Window.partitionBy("conv_id", "__segment").orderBy("seq"))
    # of a segment: its first and last time, and what opens whatever was before
    folded = rows.select("conv_id", "__segment", "seq", "ts", opens(F.col("ts"), F.last("ts", ignorenulls=True).over(local)).alias("__open")).groupBy("conv_id", "__segment").agg(
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("seq"))).alias("__first"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("seq"))).alias("__last"), F.count_if("__open").alias("__opens"),
    )
    order = preceding(scans.along(_CONV))
    carried = folded.withColumn("ts", F.last("__last", ignorenulls=True).over(order))
    carried = carried.withColumn("session_id", F.coalesce(F.sum(F.col("__opens") + opens(F.col("__first"), F.col("ts")).cast("long")).over(order), F.lit(0)))
    both = scans.begun(rows, carried.select("conv_id", "__segment", "ts", "session_id"))
    w = scans.inside(_CONV, ["seq"])
    opened = opens(F.col("ts"), F.last("ts", ignorenulls=True).over(preceding(w))).cast("long")
    numbered = both.withColumn("__open", F.when(F.col("__carry") == 1, F.col("session_id")).otherwise(opened))
    return scans.ended(numbered.withColumn("session_id", F.sum("__open").over(w)).drop("__open"))


def _runs_of_sessions(m: DataFrame, size: int) -> DataFrame:
    """run_id within the sessions that m has."""
    rows = scans.cut(m, scans.by_number(size=size))
    turned = lambda who, session, who_before, session_before: F.coalesce((session == session_before) & (who != who_before), F.lit(False)).cast("long")
    local = Window.partitionBy("conv_id", "__segment").orderBy("seq")
    changes = turned(F.col("speaker"), F.col("session_id"), F.lag("speaker").over(local), F.lag("session_id").over(local))
    end = F.struct("speaker", "session_id")
    # of a segment: its first and last message, and the changes of its last session
    marked = rows.select("conv_id", "__segment", "seq", "speaker", "session_id", changes.alias("__change"))
    folded = marked.groupBy("conv_id", "__segment", "session_id").agg(F.sum("__change").alias("n"), F.min_by(end, "seq").alias("first"), F.max_by(end, "seq").alias("last"), F.min("seq").alias("from"), F.max("seq").alias("to"))
    folded = folded.groupBy("conv_id", "__segment").agg(F.min_by("first", "from").alias("__first"), F.max_by("last", "to").alias("__last"), F.max_by("n", "to").alias("__tail"))
    order = scans.along(_CONV)
    folded = folded.withColumn("__before", F.lag("__last").over(order))
    goes_on = F.coalesce(F.col("__before.session_id") == F.col("__last.session_id"), F.lit(False))
    first = F.when(goes_on, turned(F.col("__first.speaker"), F.col("__first.session_id"), F.col("__before.speaker"), F.col("__before.session_id"))).otherwise(0)
    last_run = folded.withColumns({"__session": F.col("__last.session_id"), "__step": F.col("__tail") + first}).withColumn("__run", F.sum("__step").over(scans.along(_CONV, "__session")))
    carried = last_run.select("conv_id", "__segment", F.col("__before.speaker").alias("speaker"), F.col("__before.session_id").alias("session_id"), F.lag("__run").over(order).alias("run_id"))
    both, w = scans.begun(rows, carried), scans.inside(_CONV, ["seq"])
    change = turned(F.col("speaker"), F.col("session_id"), F.lag("speaker").over(w), F.lag("session_id").over(w))
    stepped = both.withColumn("__change", F.when(F.col("__carry") == 1, F.col("run_id")).otherwise(change))
    return scans.ended(stepped.withColumn("run_id", F.sum("__change").over(scans.inside(_CONV, ["seq"], "session_id"))).drop("__change"))


def with_runs(m: DataFrame, size: int | None = scans.SEGMENT, gap_minutes: int = L.SESSION_GAP_MINUTES) -> DataFrame:
    """session_id, and run_id from 0 within the session: consecutive messages of one speaker; m's own sessions where it has any."""
    return _runs_of_sessions(m, size or scans.SEGMENT) if "session_id" in m.columns else with_places(m, size, gap_minutes).drop("place")


def _in_windows(m: DataFrame, gap_minutes: int) -> DataFrame:
    """What with_places gives, by windows over whole conversations: a short plan, for conversations that fit a task."""
    w = Window.partitionBy("conv_id").orderBy("seq")
    last = F.last("ts", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("ts") < last) | (minutes_between(F.col("ts"), last) > gap_minutes), F.lit(False)).cast("long")
    rows = m.withColumn("__open", opens).withColumns({"session_id": F.sum("__open").over(w), "place": F.row_number().over(w).cast("long")}).drop("__open")
    s = Window.partitionBy("conv_id", "session_id").orderBy("seq")
    rows = rows.withColumn("__turn", F.coalesce((F.lag("speaker").over(s) != F.col("speaker")).cast("long"), F.lit(0)))
    return rows.withColumn("run_id", F.sum("__turn").over(s)).drop("__turn")


def with_places(m: DataFrame, size: int | None = scans.SEGMENT, gap_minutes: int = L.SESSION_GAP_MINUTES) -> DataFrame:
    """session_id, run_id and place, a message's number from 1 in its conversation, from one fold (None: no segments, see _in_windows)."""
    if size is None:
        return _in_windows(m, gap_minutes)
    rows = scans.cut(m, scans.by_number(size=size))
    opens = lambda ts, last: F.coalesce((ts < last) | (minutes_between(ts, last) > gap_minutes), F.lit(False))
    preceding = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    turned = lambda before: F.coalesce(F.col("speaker") != before, F.lit(False))
    local = Window.partitionBy("conv_id", "__segment").orderBy("seq")
    marked = rows.select("conv_id", "__segment", "seq", "ts", "speaker", F.last("ts", ignorenulls=True).over(preceding(local)).alias("__known"), turned(F.lag("speaker").over(local)).alias("__turn"))
    marked = marked.withColumn("__open", opens(F.col("ts"), F.col("__known"))).withColumn("__part", F.sum(F.col("__open").cast("long")).over(local))
    # a segment's changes of speaker: of its last session if that opens in it, after its first time, and all
    timed, turn = F.when(F.col("ts").isNotNull(), F.col("seq")), F.col("__turn") & ~F.col("__open")
    parts = marked.groupBy("conv_id", "__segment", "__part").agg(
        F.count("*").alias("n"), F.min_by("ts", timed).alias("first"), F.max_by("ts", timed).alias("last"), F.min(timed).alias("from"), F.max(timed).alias("to"),
        F.min_by("speaker", "seq").alias("speaks"), F.max_by("speaker", "seq").alias("spoke"), F.count_if(turn).alias("turns"), F.count_if(turn & F.col("__known").isNotNull()).alias("later"),
    )
    folded = parts.groupBy("conv_id", "__segment").agg(
        F.sum("n").alias("n"), F.min_by("first", "from").alias("__first"), F.max_by("last", "to").alias("__last"), F.max("__part").alias("__opens"),
        F.min_by("speaks", "__part").alias("__speaks"), F.max_by("spoke", "__part").alias("__spoke"), F.max_by("turns", "__part").alias("__tail"), F.max_by("later", "__part").alias("__later"),
    )
    order = scans.along(_CONV)
    before = preceding(order)
    carried = folded.withColumns({"ts": F.last("__last", ignorenulls=True).over(before), "speaker": F.lag("__spoke").over(order)})
    carried = carried.withColumn("__new", opens(F.col("__first"), F.col("ts")))
    begins = (F.col("__opens") > 0) | F.col("__new")
    step = F.when(F.col("__opens") > 0, F.col("__tail")).when(F.col("__new"), F.col("__later")).otherwise(F.col("__tail") + F.coalesce(F.col("__speaks") != F.col("speaker"), F.lit(False)).cast("long"))
    carried = carried.withColumns({"__step": step, "__chain": F.sum(begins.cast("long")).over(order)}).withColumn("__run", F.sum("__step").over(scans.along(_CONV, "__chain")))
    carried = carried.withColumns({
        "session_id": F.coalesce(F.sum(F.col("__opens") + F.col("__new").cast("long")).over(before), F.lit(0)),
        "run_id": F.coalesce(F.lag("__run").over(order), F.lit(0)), "place": F.coalesce(F.sum("n").over(before), F.lit(0)),
    })
    both, w = scans.begun(rows, carried.select("conv_id", "__segment", "ts", "speaker", "session_id", "run_id", "place")), scans.inside(_CONV, ["seq"])
    carry = F.col("__carry") == 1
    opened = opens(F.col("ts"), F.last("ts", ignorenulls=True).over(preceding(w)))
    both = both.withColumns({"__open": opened & ~carry, "__turn": turned(F.lag("speaker").over(w)) & ~carry})
    both = both.withColumns({
        "session_id": F.sum(F.when(carry, F.col("session_id")).otherwise(F.col("__open").cast("long"))).over(w),
        "place": F.sum(F.when(carry, F.col("place")).otherwise(1)).over(w),
    })
    stepped = F.when(carry, F.col("run_id")).otherwise((F.col("__turn") & ~F.col("__open")).cast("long"))
    return scans.ended(both.withColumn("run_id", F.sum(stepped).over(scans.inside(_CONV, ["seq"], "session_id"))).drop("__open", "__turn"))


def runs(m: DataFrame) -> DataFrame:
    """One row per run: its speaker, first and last seq and its lines in order."""
    return (
        with_runs(m).groupBy("conv_id", "session_id", "run_id").agg(
            F.first("speaker").alias("speaker"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"),
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("lines"),
        )
    )


def with_previous(m: DataFrame, **columns: str) -> DataFrame:
    """New columns with those of the message before in the conversation."""
    return scans.beside(m, columns, _CONV, ["seq"], scans.by_number())


def with_burst(m: DataFrame, gap_minutes: int = L.SESSION_GAP_MINUTES) -> DataFrame:
    """burst: the message before is the same speaker's, and no time is missing or back or beyond the gap."""
    near = F.col("__when").isNull() | F.col("ts").isNull() | minutes_between(F.col("ts"), F.col("__when")).between(0, gap_minutes)
    out = with_previous(m, __who="speaker", __when="ts")
    return out.withColumn("burst", F.coalesce((F.col("__who") == F.col("speaker")) & near, F.lit(False))).drop("__who", "__when")


def reply_gaps(m: DataFrame, gap_minutes: int = L.SESSION_GAP_MINUTES) -> DataFrame:
    """conv_id, seq, speaker, gap: minutes since the message before, where the speaker changes and the gap is 0 to 30."""
    out = with_previous(m.select("conv_id", "seq", "speaker", "ts"), __who="speaker", __when="ts").withColumn("gap", minutes_between(F.col("ts"), F.col("__when")))
    return out.where((F.col("__who") != F.col("speaker")) & F.col("gap").between(0, gap_minutes)).select("conv_id", "seq", "speaker", "gap")


def starters(m: DataFrame) -> DataFrame:
    """Who begins each session that has a time."""
    s = m if "session_id" in m.columns else with_sessions(m)
    return s.groupBy("conv_id", "session_id").agg(F.min_by("speaker", "seq").alias("starter"), F.count("ts").alias("timed"), F.count("*").alias("n")).where("timed > 0").drop("timed")


def closers(m: DataFrame) -> DataFrame:
    """Who has the last word that isn't blank in each session."""
    s = m if "session_id" in m.columns else with_sessions(m)
    return s.where(X.stripped("text") != "").groupBy("conv_id", "session_id").agg(F.max_by("speaker", "seq").alias("closer"))


def silences(m: DataFrame, days: int = 14) -> DataFrame:
    """Gaps of at least so many days between consecutive dated messages, in time order."""
    timed = m.where("ts IS NOT NULL").select("conv_id", "ts", "seq")
    out = scans.beside(timed, {"until": "ts"}, _CONV, ["ts", "seq"], F.to_date("ts"), after=True).withColumn("days", F.floor(minutes_between(F.col("until"), F.col("ts")) / 1440).cast("long"))
    return out.where(F.col("days") >= days).select("conv_id", F.col("ts").alias("since"), "until", "days")


def timeline(m: DataFrame, days: int = 14) -> DataFrame:
    """Per conversation: span, busiest month, and long gaps between days with messages."""
    timed = m.where("ts IS NOT NULL")
    span = timed.groupBy("conv_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("timed"), F.count_distinct(F.date_format("ts", "yyyy-MM")).alias("months"),
    ).withColumn("span_days", F.floor(minutes_between(F.col("last_ts"), F.col("first_ts")) / 1440).cast("long") + 1)
    w = Window.partitionBy("conv_id").orderBy("day")
    gaps = (
        timed.select("conv_id", F.to_date("ts").alias("day")).distinct().withColumn("gap", F.date_diff(F.lead("day").over(w), F.col("day")))
        .groupBy("conv_id").agg(F.count_if(F.col("gap") >= days).alias("gaps"), F.max(F.when(F.col("gap") >= days, F.col("gap"))).alias("longest_gap"))
    )
    return span.join(gaps, "conv_id")


def busiest_months(m: DataFrame, most: int = 3) -> DataFrame:
    """The busiest months of conversations with at least three; ties go to the month that comes first in time."""
    by = m.where("ts IS NOT NULL").groupBy("conv_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("conv_id")
    ranked = by.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "month")), "months": F.count("*").over(w)})
    return ranked.where((F.col("rank") <= most) & (F.col("months") >= 3)).select("conv_id", "month", "n", "rank")


def message_index(m: DataFrame) -> DataFrame:
    """Message numbers, ids, content keys, dates and sessions from 1."""
    return scans.numbered(with_sessions(m), "index", _CONV, ["seq"], scans.by_number()).select(
        "conv_id", "index", X.message_id("index", "ts", "speaker", "text").alias("id"), X.content_key("ts", "speaker", "text").alias("key"),
        F.when(F.col("ts").isNotNull(), X.iso("ts")).alias("time"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "speaker", "text",
        (F.col("session_id") + 1).alias("session"), "source_id", "reply_to",
    )


def neighbours(m: DataFrame) -> DataFrame:
    """Each line with the one before and the one after."""
    rows = m.select("conv_id", "seq", F.posexplode(X.lines("text")).alias("pos", "line"))
    return scans.around(rows, "line", _CONV, ["seq", "pos"], scans.by_number())
