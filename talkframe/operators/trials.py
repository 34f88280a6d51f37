"""States that hold only while a pack's content stays the same: saved replies, hold-out cases, comparisons of two sides, baselines and increments.

A state is a table of rows with the fingerprint of the content they belong to; rows of another fingerprint are stale.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators import changes as C
from talkframe.operators import exchanges as E
from talkframe.operators import review as R


def freshness(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Saved rows (conv_id, fingerprint, ...) with `stale`, against the current fingerprints (conv_id, fingerprint)."""
    now = current.select("conv_id", F.col("fingerprint").alias("now"))
    return saved.join(now, "conv_id", "left").withColumn("stale", ~F.col("fingerprint").eqNullSafe(F.col("now"))).drop("now")


def recorded(saved: DataFrame, new: DataFrame, current: DataFrame, known: DataFrame, longest: int | None = 4000) -> DataFrame:
    """Replies (conv_id, id, reply, fingerprint, at) after new ones: only of the current content and of known cases, the last of each case, cut at `longest` characters (None: whole)."""
    fresh = lambda rows: freshness(rows, current).where("not stale").drop("stale")
    both = fresh(saved).unionByName(fresh(new)).join(known.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_semi")
    last = both.groupBy("conv_id", "id").agg(F.max_by(F.struct("reply", "fingerprint", "at"), "at").alias("r")).select("conv_id", "id", "r.*")
    return last if longest is None else last.withColumn("reply", F.left("reply", F.lit(longest)))


def holdout_cases(m: DataFrame, sides: DataFrame, percent: int, most: int | None = 100, situations: Sequence[tuple[str, str, str, str]] = L.SITUATIONS, most_chars: int = 80) -> DataFrame:
    """Cases of the sessions held out: conv_id, id, label, prompt, expected_move, allowed_quotes, origin; the first `most` of a conversation (None: all)."""
    test = C.holdout(m, percent).where("test").drop("session_id", "test")
    rows = E.classified(E.exchanges(test, sides, most_chars=most_chars), situations)
    move = F.when(F.coalesce("action", F.lit("")) == "", L.HOLDOUT_MOVE).otherwise(F.col("action"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.get("reply_messages", F.lit(0))))
    rows = rows.withColumn("n", n)
    rows = rows if most is None else rows.where(F.col("n") <= most)
    return rows.select("conv_id", F.concat(F.lit("holdout-"), F.col("n").cast("string")).alias("id"), "label", F.array_join("incoming", " ").alias("prompt"), move.alias("expected_move"), F.col("reply").alias("allowed_quotes"), F.lit("holdout").alias("origin"))


def holdout_keys(m: DataFrame, percent: int) -> DataFrame:
    """The content keys of the messages held out, a row each: conv_id, seq, key."""
    return C.holdout(m, percent).where("test").select("conv_id", "seq", X.content_key("ts", "speaker", "text").alias("key"))


def require_sessions(m: DataFrame, percent: int, least: int = 3) -> None:
    """Raise where a share is to be held out of a conversation with fewer sessions than a hold-out needs; names one of them."""
    if percent:
        few = C.with_sessions(m).groupBy("conv_id").agg(F.count_distinct("session_id").alias("n")).where(F.col("n") < least).orderBy("conv_id").first()
        if few is not None:
            raise ValueError(f"a hold-out needs {least} whole sessions; {few['conv_id']} has {few['n']}")


def holdout_summary(m: DataFrame, percent: int) -> DataFrame:
    """Per conversation the sessions of both parts and a fingerprint of the test messages."""
    parts = C.holdout(m, percent)
    sessions = parts.groupBy("conv_id").agg(F.count_distinct(F.when(~F.col("test"), F.col("session_id"))).alias("train_sessions"), F.count_distinct(F.when(F.col("test"), F.col("session_id"))).alias("test_sessions"))
    keys = parts.where("test").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", X.content_key("ts", "speaker", "text").alias("key")))).alias("k"))
    keys = keys.select("conv_id", F.left(F.sha2(F.array_join("k.key", "\n").cast("binary"), 256), F.lit(16)).alias("test_id"))
    return sessions.join(keys, "conv_id", "left").withColumn("test_id", F.coalesce("test_id", F.lit("")))


def comparison(cases: DataFrame, seed: int = 0) -> DataFrame:
    """Cases (conv_id, id) with the side that is shown first, drawn by seed, conversation and case: conv_id, id, first, second."""
    heads = F.xxhash64(F.lit(seed), "conv_id", "id").bitwiseAND(F.lit(1)) == 0
    return cases.select("conv_id", "id", F.when(heads, "a").otherwise("b").alias("first"), F.when(heads, "b").otherwise("a").alias("second"))


def shown_results(run: DataFrame, results: DataFrame, blind: bool = True) -> DataFrame:
    """Results (conv_id, id, side, reply) under the names they are shown by: the sides' own, or their places where the run is blind."""
    shown = F.when(F.col("side") == F.col("first"), "a").otherwise("b") if blind else F.col("side")
    return results.join(run, ["conv_id", "id"]).select("conv_id", "id", shown.alias("shown"), "reply")


def choices(run: DataFrame, results: DataFrame, votes: DataFrame, blind: bool = True) -> DataFrame:
    """Votes (conv_id, id, choice, at) by the side that was meant: the last vote of each case that has both results; a tie or neither stays what it is.

    Where results have `at`, votes that aren't later than the last result of their case are dropped: they were of another reply.
    """
    timed = "at" in results.columns
    done = results.groupBy("conv_id", "id").agg(F.count_distinct("side").alias("n"), *([F.max("at").alias("changed")] if timed else [])).where("n = 2").drop("n")
    votes = votes.join(done, ["conv_id", "id"]).where(F.col("changed").isNull() | (F.col("at") > F.col("changed"))).select(votes.columns) if timed else votes
    done = done.select("conv_id", "id")
    last = votes.where(F.col("choice").isin("a", "b", "tie", "neither")).groupBy("conv_id", "id").agg(F.max_by("choice", "at").alias("choice"))
    meant = F.when(F.col("choice") == "a", F.col("first")).when(F.col("choice") == "b", F.col("second")).otherwise(F.col("choice")) if blind else F.col("choice")
    return last.join(done, ["conv_id", "id"]).join(run, ["conv_id", "id"]).select("conv_id", "id", meant.alias("side"))


def verdict(run: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per conversation cases, choices, wins of both sides, and whether all are chosen, when a blind run is revealed."""
    rows = run.join(chosen, ["conv_id", "id"], "left")
    wins = [F.count_if(F.coalesce(F.col("side") == s, F.lit(False))).alias(f"{s}_wins") for s in "ab"]
    return rows.groupBy("conv_id").agg(F.count("*").alias("cases"), F.count("side").alias("chosen"), *wins, (F.count("*") == F.count("side")).alias("revealed"))


def fresh_runs(run: DataFrame, current: DataFrame) -> DataFrame:
    """The cases of a run (..., fingerprint) whose content is still current; a run of other content takes no result and no vote."""
    return freshness(run, current).where("not stale").drop("stale")


def summary(run: DataFrame, results: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per revealed conversation and side wins, passed replies and seconds (one decimal): conv_id, side, wins, passed, seconds.

    results: conv_id, id, side, passed, seconds, at; the last of a case and side counts, a null is no pass and no time. chosen: `choices`.
    Conversations with a case that isn't chosen yet are left out, as their sides stay hidden.
    """
    last = results.join(run.select("conv_id", "id"), ["conv_id", "id"], "left_semi").groupBy("conv_id", "id", "side").agg(F.max_by(F.struct("passed", "seconds"), "at").alias("r"))
    sums = last.groupBy("conv_id", "side").agg(F.count_if("r.passed").alias("passed"), F.bround(F.sum(F.coalesce("r.seconds", F.lit(0.0))), 1).alias("seconds"))
    open_ = verdict(run, chosen).where("revealed")
    sides = open_.select("conv_id", F.inline(F.array(F.struct(F.lit("a").alias("side"), F.col("a_wins").alias("wins")), F.struct(F.lit("b").alias("side"), F.col("b_wins").alias("wins")))))
    return sides.join(sums, ["conv_id", "side"], "left").select("conv_id", "side", "wins", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def save_baseline(m: DataFrame, folder: str, name: str, redact: bool = True) -> None:
    """Messages with their content keys, redacted, under a name that stays: an existing baseline is never overwritten."""
    rows = C.keyed(m.withColumn("text", X.redacted("text")) if redact else m).drop("copy")
    rows.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}")


def baseline(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}").drop("key")


@dataclass
class Increment:
    """What an increment leads to. messages: all of them, numbered on; sections and ledger after it; conflicts to review."""

    messages: DataFrame
    sections: DataFrame
    ledger: DataFrame
    conflicts: DataFrame


def applied_increment(known: DataFrame, incoming: DataFrame, sections: DataFrame, ledger: DataFrame, quotes: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> Increment:
    """Known messages with the additions of incoming ones.

    Sections (section, ordinal, text) of the additions alone come from `analyse` and are merged behind the old ones; memories
    (conv_id, memory_id, status, ...) that an addition may cancel become uncertain. quotes: conv_id, memory_id, quote.
    """
    added = C.additions(known, incoming)
    last = known.groupBy("conv_id").agg(F.max("seq").alias("last"))
    numbered = added.join(last, "conv_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.col("message")).select(known.columns)
    facts = ledger.select("conv_id", "memory_id", "status").join(quotes.select("conv_id", "memory_id", "quote"), ["conv_id", "memory_id"])
    found = C.conflicts(added, facts)
    doubt = found.select("conv_id", "memory_id").distinct().withColumn("doubt", F.lit(True))
    after = ledger.join(doubt, ["conv_id", "memory_id"], "left").withColumn("status", F.when(F.col("doubt"), "uncertain").otherwise(F.col("status"))).drop("doubt")
    parts = sections.select(F.lit(0).alias("part"), "section", "ordinal", "text").unionByName(analyse(numbered).select(F.lit(1).alias("part"), "section", "ordinal", "text"))
    return Increment(known.unionByName(numbered), C.merged_sections(parts), after, found)


def append_log(rows: DataFrame, folder: str) -> None:
    """Add rows to a log of JSON lines; what is there stays as it is."""
    rows.write.mode("append").json(folder)


def last_rows(rows: DataFrame, by: str, order: str, most: int = 200) -> DataFrame:
    """The last rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("__n") <= most).drop("__n")


def log_tail(spark: SparkSession, folder: str, schema: str, order: str, most: int = 200, by: str | None = None) -> DataFrame:
    """The last rows of a log (of each group); broken lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder).where(F.col(order).isNotNull())
    if by is None:
        return rows.orderBy(F.desc(order)).limit(most)
    return last_rows(rows, by, order, most)


def checked_replies(saved: DataFrame, current: DataFrame, cases: DataFrame, routes: DataFrame, situations: Sequence[tuple[str, str, str, str]] = L.SITUATIONS) -> DataFrame:
    """review.checked over the replies that are fresh; cases whose replies are stale count as not checked."""
    return R.checked(cases, freshness(saved, current).where("not stale").select("conv_id", "id", "reply"), routes, situations)
