"""Incremental merges, conflicts, hold-out splits and version differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators import scans
from talkframe.operators.evidence import quoting
from talkframe.operators.sessions import with_sessions


def keyed(m: DataFrame) -> DataFrame:
    """Messages with their content key and the how-manieth of that key they are."""
    out = m.withColumn("key", X.content_key("ts", "speaker", "text"))
    return out.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "key").orderBy("seq")))


def additions(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming messages beyond the known ones; each known message absorbs one equal incoming message.

    `message` numbers the additions from 1.
    """
    # of what is known only keys that come in are counted
    came = incoming.select("conv_id", X.content_key("ts", "speaker", "text").alias("key")).distinct()
    had = known.select("conv_id", X.content_key("ts", "speaker", "text").alias("key")).join(came, ["conv_id", "key"], "left_semi").groupBy("conv_id", "key").agg(F.count("*").alias("had"))
    new = keyed(incoming).join(had, ["conv_id", "key"], "left").where(F.col("copy") > F.coalesce("had", F.lit(0))).drop("had", "copy")
    return scans.numbered(new, "message", ["conv_id"], ["seq"], scans.by_number())


def conflicts(added: DataFrame, facts: DataFrame, marks: Sequence[str] = L.CONFLICT_MARKS, stop: Sequence[str] = L.CONFLICT_STOP_GRAMS, cjk: bool = True) -> DataFrame:
    """Facts, promises and plans (conv_id, memory_id, status, quote) that share a two-character gram with an addition that negates or cancels."""
    grams = facts.where(F.col("status").isin("fact", "promise", "plan")).select("conv_id", "memory_id", F.explode(X.ngrams("quote", 2, 2)).alias("gram"))
    wanted = X.is_cjk("gram") if cjk else F.col("gram").rlike("^[a-z]{2}$")
    grams = grams.where(wanted & ~F.col("gram").isin(*stop)).distinct()
    said = added.where(X.any_of("text", marks)).select("conv_id", "message", "text", F.explode(X.bigrams("text")).alias("gram"))
    return said.join(grams, ["conv_id", "gram"]).select("conv_id", "memory_id", "message", F.col("text").alias("quote")).distinct()


def holdout(m: DataFrame, percent: int) -> DataFrame:
    """Messages with `test`: whole sessions of the smallest hashes, at most percent of them, at least one, and two always stay.

    Conversations of fewer than three sessions stay whole.
    """
    if not 0 <= percent <= 40:
        raise ValueError("percent must be from 0 to 40")
    s = with_sessions(m)
    keys = s.groupBy("conv_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("seq", X.content_key("ts", "speaker", "text").alias("key")))).alias("k"))
    rank = keys.select("conv_id", "session_id", F.sha2(F.array_join("k.key", "\n").cast("binary"), 256).alias("h"))
    w = Window.partitionBy("conv_id")
    rank = rank.withColumns({"place": F.row_number().over(w.orderBy("h", "session_id")), "n": F.count("*").over(w)})
    take = F.when((F.lit(percent) > 0) & (F.col("n") >= 3), F.least(F.col("n") - 2, F.greatest(F.lit(1), F.floor(F.col("n") * percent / 100)))).otherwise(0)
    return s.join(rank.select("conv_id", "session_id", (F.col("place") <= take).alias("test")), ["conv_id", "session_id"])


def training_feedback(feedback: DataFrame, test: DataFrame, least: int = 4) -> DataFrame:
    """Feedback (id, text) without rows that contain a test message of `least` characters and more."""
    quotes = test.where(F.length("text") >= least).select(F.lit("").alias("conv_id"), F.col("text").alias("claim")).distinct().withColumn("item_id", F.xxhash64("claim"))
    hit = quoting(quotes, feedback.select(F.lit("").alias("conv_id"), F.col("id").alias("seq"), "text"))
    return feedback.join(hit.select(F.col("seq").alias("id")).distinct(), "id", "left_anti")


def version_changes(old: DataFrame, new: DataFrame, order: str = "sha256") -> DataFrame:
    """Paths (path, sha256) that were added, removed or changed, a row each: of rows that repeat a path the first by `order` with a hash counts."""
    once = lambda df, name: df.groupBy("path").agg(F.min_by("sha256", F.when(F.col("sha256").isNotNull(), F.col(order))).alias(name))
    both = once(old, "was").join(once(new, "now"), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def merged_sections(parts: DataFrame) -> DataFrame:
    """Ordered union without repeats of section items (part, section, ordinal, text)."""
    first = parts.groupBy("section", "text").agg(F.min(F.struct("part", "ordinal")).alias("at"))
    return first.select("section", F.row_number().over(Window.partitionBy("section").orderBy("at")).alias("ordinal"), "text")


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def manual_links(m: DataFrame, links: DataFrame) -> DataFrame:
    """Messages with reply_to set by links (conv_id, reply_key, source_key).

    Both keys must be unique, the source earlier and of another speaker. A source without an id of its own gets one
    from its key.
    """
    rows = m.withColumn("key", X.content_key("ts", "speaker", "text")).withColumn("same", F.count("*").over(Window.partitionBy("conv_id", "key")))
    rows = rows.withColumn("same_id", F.count("*").over(Window.partitionBy("conv_id", "source_id")))
    own = F.when((F.col("source_id") != "") & (F.col("same_id") == 1), F.col("source_id")).otherwise(F.concat(F.lit("manual-"), F.left("key", F.lit(16))))
    unique = rows.where("same = 1")
    source = unique.select("conv_id", F.col("key").alias("source_key"), F.col("seq").alias("source_seq"), F.col("speaker").alias("source_speaker"), own.alias("new_id"))
    reply = unique.select("conv_id", F.col("key").alias("reply_key"), F.col("seq").alias("reply_seq"), F.col("speaker").alias("reply_speaker"))
    good = links.join(source, ["conv_id", "source_key"]).join(reply, ["conv_id", "reply_key"]).where("source_seq < reply_seq AND source_speaker <> reply_speaker")
    ids = good.select("conv_id", F.col("source_seq").alias("seq"), "new_id").distinct()
    to = good.groupBy("conv_id", F.col("reply_seq").alias("seq")).agg(F.max("new_id").alias("new_to"))
    out = m.join(ids, ["conv_id", "seq"], "left").join(to, ["conv_id", "seq"], "left")
    return out.withColumns({"source_id": F.coalesce("new_id", "source_id"), "reply_to": F.coalesce("new_to", "reply_to")}).select(m.columns)
