"""Speaker profiles: volume, rhythm, style, mood, warmth, relation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators.sessions import closers, reply_gaps, starters, with_burst, with_previous, with_sessions


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.bround(part / whole * 100, digits)).otherwise(0.0)


def speaker_profile(m: DataFrame) -> DataFrame:
    """One row per conversation and speaker, from one pass over windows and two aggregations on the same key."""
    hour = F.hour("ts")
    rows = with_burst(with_sessions(m))
    base = rows.groupBy("conv_id", "speaker").agg(
        F.count("*").alias("messages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("ts").alias("timed"),
        F.count_if((hour >= 23) | (hour <= 5)).alias("late_night"), F.sum(F.length("text")).alias("chars"),
        F.count_if("burst").alias("bursts"), F.count_if(X.is_question("text")).alias("questions"), F.count_if(F.size(X.emoji("text")) > 0).alias("with_emoji"),
    )
    gaps = reply_gaps(m).groupBy("conv_id", "speaker").agg(F.bround(F.median("gap"), 1).alias("reply_gap"))
    begun = starters(rows).groupBy("conv_id", F.col("starter").alias("speaker")).agg(F.count("*").alias("sessions_started"))
    n = F.col("messages")
    return (
        base.join(gaps, ["conv_id", "speaker"], "left").join(begun, ["conv_id", "speaker"], "left").select(
            "conv_id", "speaker", "messages", "first_ts", "last_ts", "timed", "late_night", F.bround(F.col("chars") / n, 1).alias("avg_len"),
            share(F.col("bursts"), n).alias("burst_ratio"), share(F.col("questions"), n).alias("question_ratio"), share(F.col("with_emoji"), n).alias("emoji_ratio"),
            F.coalesce("reply_gap", F.lit(0.0)).alias("reply_gap"), F.coalesce("sessions_started", F.lit(0)).alias("sessions_started"),
        )
    )


def per_speaker(m: DataFrame) -> DataFrame:
    return m.groupBy("conv_id", "speaker").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def targets(m: DataFrame, me: Sequence[str] = (L.SELF_SPEAKER,)) -> DataFrame:
    """Per conversation the speaker with most messages who isn't oneself; ties go to who spoke first."""
    who = per_speaker(m).where(~F.col("speaker").isin(*me))
    return who.groupBy("conv_id").agg(F.min_by("speaker", F.struct(-F.col("n"), "first_seq")).alias("target"))


def counterparts(m: DataFrame, target: DataFrame | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    """conv_id, target, counterpart: the most frequent other speaker."""
    target = targets(m) if target is None else target
    who = per_speaker(m).where(~F.col("speaker").isin(*ignore)) if ignore else per_speaker(m)
    return who.join(target, "conv_id").where("speaker <> target").groupBy("conv_id", "target").agg(F.min_by("speaker", F.struct(-F.col("n"), "first_seq")).alias("counterpart"))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at rank round(q * (n - 1)) of a collected array, half to even; null if empty."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.bround(q * (F.size(values) - 1)).cast("int"))


def gap_summary(m: DataFrame, q: float = 0.9, buckets_per_minute: int | None = None) -> DataFrame:
    """Median and nearest-rank percentile of reply gaps per speaker.

    Gaps are counted by value first, so a hot speaker costs as many rows as there are different gaps.
    """
    by = reply_gaps(m).groupBy("conv_id", "speaker", "gap").agg(F.count("*").alias("n"))
    w = Window.partitionBy("conv_id", "speaker")
    run = by.withColumns({"upto": F.sum("n").over(w.orderBy("gap")), "total": F.sum("n").over(w)})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("gap")))
    last = F.col("total") - 1
    return run.groupBy("conv_id", "speaker").agg(
        F.max("total").alias("gaps"), ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("median_gap"), at(F.bround(q * last)).alias("high_gap"),
    )


def hours(m: DataFrame) -> DataFrame:
    return m.where("ts IS NOT NULL").groupBy("conv_id", "speaker", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def emoji_counts(m: DataFrame) -> DataFrame:
    return m.select("conv_id", "speaker", F.explode(X.emoji("text")).alias("emoji")).groupBy("conv_id", "speaker", "emoji").agg(F.count("*").alias("n"))


def word_messages(m: DataFrame, words: Sequence[str] = L.CONFLICT_WORDS) -> DataFrame:
    """Messages that contain a word, once each."""
    hit = F.array_compact(F.array(*(F.when(F.col("text").contains(w), w) for w in dict.fromkeys(words))))
    return m.select("conv_id", "speaker", F.explode(hit).alias("word")).groupBy("conv_id", "speaker", "word").agg(F.count("*").alias("n"))


def phrase_counts(m: DataFrame, stop: Sequence[str] = L.STOP_PHRASES) -> DataFrame:
    return m.select("conv_id", "speaker", F.explode(X.phrases("text", stop)).alias("phrase")).groupBy("conv_id", "speaker", "phrase").agg(F.count("*").alias("n"))


def word_counts(m: DataFrame, words: Sequence[str], undouble: bool = False) -> DataFrame:
    """Non-overlapping occurrences of each word; with undouble, doubled CJK characters are taken out first."""
    text = F.regexp_replace("text", r"([\x{4e00}-\x{9fa5}])\1", "") if undouble else F.col("text")
    parts = [F.struct(F.lit(w).alias("word"), X.occurrences(text, w).alias("n")) for w in dict.fromkeys(words)]
    return m.select("conv_id", "speaker", F.explode(F.array(*parts)).alias("x")).where("x.n > 0").groupBy("conv_id", "speaker", "x.word").agg(F.sum("x.n").alias("n"))


def laugh_counts(m: DataFrame, words: Sequence[str] = L.LAUGH_WORDS) -> DataFrame:
    """Laughs, longer ones first, and doubled CJK characters that aren't part of one."""
    laughs = F.regexp_extract_all("text", F.lit(X.alternation(words)), F.lit(0))
    doubled = F.regexp_extract_all("text", F.lit(r"([\x{4e00}-\x{9fa5}])\1"), F.lit(0))
    known = F.array(*map(F.lit, words))
    other = F.filter(doubled, lambda d: ~F.exists(known, lambda w: w.contains(d)))
    return m.select("conv_id", "speaker", F.explode(F.concat(laughs, other)).alias("word")).groupBy("conv_id", "speaker", "word").agg(F.count("*").alias("n"))


def style(m: DataFrame) -> DataFrame:
    """Length, end punctuation, sentence kinds and bursts of messages that aren't blank."""
    rows = with_previous(m, __who="speaker").withColumn("again", F.coalesce(F.col("__who") == F.col("speaker"), F.lit(False)))
    again = rows.groupBy("conv_id", "speaker").agg(F.count_if("again").alias("bursts"))
    t, n = X.stripped("text"), F.count("*")
    ends = lambda *e: F.count_if(t.rlike("(" + "|".join(map(_escaped, e)) + ")$"))
    size = F.length("text")
    return rows.where(t != "").groupBy("conv_id", "speaker").agg(
        n.alias("messages"), F.median(size).alias("median_len"), F.bround(F.avg(size), 1).alias("avg_len"),
        share(F.count_if(size <= 8), n, 0).alias("short_pct"), share(F.count_if(size >= 40), n, 0).alias("long_pct"),
        share(F.count_if(~F.right(t, F.lit(1)).isin(*L.SENTENCE_ENDS)), n, 0).alias("no_end_pct"), share(ends("。"), n, 0).alias("period_pct"),
        share(ends("~", "～"), n, 0).alias("wave_pct"), share(ends("！", "!"), n, 0).alias("mark_pct"), share(F.count_if(X.is_question("text")), n, 0).alias("question_pct"),
        share(ends("！", "!", "哈哈", "啦"), n, 0).alias("exclaim_pct"), share(F.count_if(F.col("text").contains("\n")), n, 0).alias("multi_line_pct"),
    ).join(again, ["conv_id", "speaker"])


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}!" else c for c in text)


def mood(
    m: DataFrame, positive: Sequence[str] = L.POSITIVE_WORDS, negative: Sequence[str] = L.NEGATIVE_WORDS, care: Sequence[str] = L.CARE_WORDS,
    conflict: Sequence[str] = L.CONFLICT_WORDS, laugh: Sequence[str] = L.LAUGH_WORDS, low: Sequence[str] = L.LOW_MOOD_WORDS, direct: Sequence[str] = L.SAID_DIRECTLY,
) -> DataFrame:
    """Hits and messages by kind of expression, and the balance of positive ones."""
    media = X.is_media_only("text", 24)
    rows = m.where(X.stripped("text") != "").select(
        "conv_id", "speaker", X.matches("text", positive).alias("pos"), X.matches("text", negative).alias("neg"), X.matches("text", care).alias("care"),
        (X.any_of("text", conflict) & ~media).alias("conflict"), ((X.matches("text", laugh) > 0) & ~media).alias("laugh"),
        (X.any_of("text", low) & ~media).alias("low"), (X.any_of("text", direct) & ~media).alias("direct"),
    )
    out = rows.groupBy("conv_id", "speaker").agg(
        F.count("*").alias("messages"), F.sum("pos").alias("positive"), F.sum("neg").alias("negative"), F.sum("care").alias("care"),
        F.count_if(F.col("pos") > 0).alias("positive_messages"), F.count_if(F.col("neg") > 0).alias("negative_messages"), F.count_if(F.col("care") > 0).alias("care_messages"),
        F.count_if("conflict").alias("conflict_messages"), F.count_if("laugh").alias("laugh_messages"), F.count_if(F.col("low") & (F.col("pos") == 0)).alias("low_messages"),
        F.count_if("direct").alias("direct_messages"),
    )
    balance = 100 * F.col("positive") / (F.col("positive") + F.col("negative"))
    return out.withColumn("tone", F.when(F.col("positive") + F.col("negative") > 0, F.when(balance >= 65, "warm").when(balance <= 40, "cool").otherwise("even")))


def warmth(m: DataFrame, care: Sequence[str] = L.CARE_WORDS, pets: Sequence[str] = L.PET_NAMES, direct: Sequence[str] = L.DIRECT_WORDS) -> DataFrame:
    """Messages with care, pet names, direct words and emoji, what carries most, and what never occurs."""
    faces = F.size(F.filter(X.emoji("text"), lambda e: ~e.rlike(f"^{L.MEDIA_PLACEHOLDER}$"))) > 0
    emoji_ = F.col("text").contains("[表情]") | F.col("text").contains("[动画表情]") | faces
    out = m.where(X.stripped("text") != "").groupBy("conv_id", "speaker").agg(
        F.count("*").alias("messages"), F.count_if(X.any_of("text", care)).alias("care"), F.count_if(X.any_of("text", pets)).alias("pets"),
        F.count_if(X.any_of("text", direct)).alias("direct"), F.count_if(emoji_).alias("emoji"),
    )
    kinds = ("care", "pets", "direct", "emoji")
    best = F.greatest(*kinds)
    carrier = F.coalesce(*(F.when((F.col(k) == best) & (best > 0), k) for k in kinds))
    return out.withColumns({"carrier": carrier, "missing": F.array_join(F.array_compact(F.array(*(F.when(F.col(k) == 0, k) for k in kinds))), ",")})


def relation_density(m: DataFrame, signals: Mapping[str, Sequence[str]] = L.RELATION_SIGNALS) -> DataFrame:
    """Hits per thousand characters of each relation's words; a word listed twice counts twice."""
    rows = m.where(X.stripped("text") != "")
    sums = {name: F.sum(sum((X.occurrences("text", w) for w in words), F.lit(0))) for name, words in signals.items()}
    out = rows.groupBy("conv_id", "speaker").agg(F.sum(F.length("text")).alias("chars"), *(s.alias(f"hits_{k}") for k, s in enumerate(sums.values())))
    parts = [F.struct(F.lit(k).alias("place"), F.lit(name).alias("relation"), (F.col(f"hits_{k}") / F.greatest("chars", F.lit(1)) * 1000).alias("density")) for k, name in enumerate(signals)]
    return out.select("conv_id", "speaker", F.inline(F.array(*parts)))


def relation(m: DataFrame, signals: Mapping[str, Sequence[str]] = L.RELATION_SIGNALS, least: float = L.RELATION_MIN_DENSITY) -> DataFrame:
    """The densest relation of each speaker if it is dense enough; ties go to the first listed."""
    best = relation_density(m, signals).groupBy("conv_id", "speaker").agg(F.min_by(F.struct("relation", "density"), F.struct(-F.col("density"), "place")).alias("best"))
    return best.select("conv_id", "speaker", F.when(F.col("best.density") < least, L.DEFAULT_RELATION).otherwise(F.col("best.relation")).alias("relation"), F.bround("best.density", 4).alias("density"))


def relation_metrics(m: DataFrame) -> DataFrame:
    """Per conversation and speaker: gaps, starts, closings, share of messages and mean length."""
    s = with_sessions(m)
    size = F.when(X.stripped("text") != "", F.length("text"))
    base = m.groupBy("conv_id", "speaker").agg(F.count("*").alias("messages"), F.bround(F.avg(size), 1).alias("avg_len"))
    began = starters(s).groupBy("conv_id", F.col("starter").alias("speaker")).agg(F.count("*").alias("began"))
    closed = closers(s).groupBy("conv_id", F.col("closer").alias("speaker")).agg(F.count("*").alias("closed"))
    total = F.sum("messages").over(Window.partitionBy("conv_id"))
    out = base.join(gap_summary(m), ["conv_id", "speaker"], "left").join(began, ["conv_id", "speaker"], "left").join(closed, ["conv_id", "speaker"], "left")
    return out.select(
        "conv_id", "speaker", "messages", "avg_len", share(F.col("messages"), total, 0).alias("share_pct"), F.coalesce("began", F.lit(0)).alias("began"),
        F.coalesce("closed", F.lit(0)).alias("closed"), F.bround("median_gap", 4).alias("median_gap"), F.bround("high_gap", 4).alias("high_gap"),
    )


def style_rules(m: DataFrame, particles: Sequence[str] = L.TONE_PARTICLES) -> DataFrame:
    """Line-level facts behind style rules: end punctuation, median length, frequent particles and emoji."""
    lines = m.select("conv_id", "speaker", "seq", F.explode(X.lines("text")).alias("text"))
    size, n = F.length("text"), F.count("*")
    facts = lines.groupBy("conv_id", "speaker").agg(
        n.alias("lines"), F.count_if(~F.right("text", F.lit(1)).isin(*L.SENTENCE_ENDS)).alias("no_end"), F.median(size).alias("median_len"),
    )
    tone = word_counts(lines, particles, undouble=True).where("n >= 3")
    first = {p: k for k, p in enumerate(particles)}
    place = F.create_map(*(F.lit(x) for kv in first.items() for x in kv))
    w = Window.partitionBy("conv_id", "speaker").orderBy(F.desc("n"), place[F.col("word")])
    top = tone.withColumn("rank", F.row_number().over(w)).where("rank <= 4").groupBy("conv_id", "speaker").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), "、").alias("particles")
    )
    ratio = F.col("no_end") / F.col("lines")
    return facts.join(top, ["conv_id", "speaker"], "left").select(
        "conv_id", "speaker", "lines", F.when(ratio > 0.6, "no_end_punctuation").when(ratio < 0.2, "full_punctuation").alias("punctuation_rule"),
        (F.col("median_len") <= 8).alias("short_lines"), F.coalesce("particles", F.lit("")).alias("particles"),
    )
