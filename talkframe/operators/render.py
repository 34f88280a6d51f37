"""Markdown of small result frames; what is collected here has a row a section, a speaker or a situation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X


def titles(spark: SparkSession) -> DataFrame:
    """(relation, field, title)."""
    rows = [(r, f, t) for r, names in L.SECTION_TITLES.items() for f, t in zip(L.MEMORY_KINDS, names, strict=True)]
    return spark.createDataFrame(rows, "relation string, field string, title string")


def titled(sections: DataFrame) -> DataFrame:
    """Sections (relation, field) with their title; unknown relations use the default one's, unknown fields their own name."""
    known = [*L.SECTION_TITLES]
    names = titles(sections.sparkSession).withColumnRenamed("relation", "shown")
    rows = sections.withColumn("shown", F.when(F.col("relation").isin(*known), F.col("relation")).otherwise(L.DEFAULT_RELATION))
    return rows.join(F.broadcast(names), ["shown", "field"], "left").withColumn("title", F.coalesce("title", "field")).drop("shown")


def bullets(items: DataFrame) -> DataFrame:
    """One Markdown text a conversation from items (conv_id, section, ordinal, text): a heading a section, a bullet an item."""
    lines = items.groupBy("conv_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: F.concat(F.lit("- "), x["text"])).alias("lines"))
    body = F.concat(F.lit("## "), "section", F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n"))
    return lines.select("conv_id", F.struct("section", body.alias("body")).alias("s")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["body"]), "\n").alias("markdown"))


def profile_markdown(profile: DataFrame) -> DataFrame:
    """One line a conversation and speaker of a speaker profile."""
    pct = lambda c: F.concat(F.format_string("%.0f", F.col(c)), F.lit("%"))
    line = F.concat(
        F.lit("- "), "speaker", F.lit("："), F.col("messages").cast("string"), F.lit(" 条，平均 "), F.format_string("%.1f", F.col("avg_len")), F.lit(" 字，主动开口 "), F.col("sessions_started").cast("string"),
        F.lit(" 次，通常隔 "), X.minutes_text("reply_gap"), F.lit("回；连发 "), pct("burst_ratio"), F.lit("，问句 "), pct("question_ratio"), F.lit("，表情 "), pct("emoji_ratio"),
    )
    return profile.select("conv_id", "speaker", line.alias("line"))


def scenario_markdown(scenarios: DataFrame) -> DataFrame:
    """One Markdown text a conversation: situations by rank with signals, move, strength and examples."""
    shown = F.transform("examples", lambda e: F.concat(F.lit("- 真实接法：对方："), F.array_join(e["incoming"], " / "), F.lit(" → 我："), F.array_join(e["reply"], " / ")))
    strength = F.when(F.col("confidence") == "repeated_observation", "多段会话重复").otherwise("单次观察")
    body = F.concat_ws(
        "\n", F.concat(F.lit("### "), "label"), F.concat(F.lit("- 触发信号："), F.coalesce(F.nullif(F.array_join("signals", "、"), F.lit("")), F.lit("相似语境"))), F.concat(F.lit("- 回应动作："), "response_move"),
        F.concat(F.lit("- 证据强度："), strength, F.lit("（"), F.col("sessions").cast("string"), F.lit(" 段会话）")), F.array_join(shown, "\n"),
    )
    return scenarios.select("conv_id", F.struct("rank", body.alias("body")).alias("s")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["body"]), "\n\n").alias("markdown"))


def transcript_rows(texts: DataFrame) -> DataFrame:
    """Lines of written transcripts (conv_id, text) as messages again: conv_id, n, ts, speaker, text."""
    line = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}|（无时间）) ([^：]+)：(.*)$"
    rows = texts.select("conv_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.col("line").rlike(line))
    part = lambda k: F.regexp_extract("line", line, k)
    ts = F.try_to_timestamp(F.when(part(1) != L.UNTIMED, part(1)), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    return rows.select("conv_id", "n", ts.alias("ts"), part(2).alias("speaker"), part(3).alias("text"))
