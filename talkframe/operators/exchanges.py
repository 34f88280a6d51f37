"""Pairs of incoming messages and replies, their situations, scenarios and selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators.messages import in_order
from talkframe.operators.sessions import minutes_between, with_runs

COLUMNS = ("conv_id", "session_id", "incoming", "reply", "incoming_messages", "reply_messages", "pairing")


def adjacent(m: DataFrame, sides: DataFrame, most_lines: int = 3, most_chars: int = 80) -> DataFrame:
    """A counterpart's run followed at once by the target's in the same session. sides: conv_id, target, counterpart.

    A run keeps at most most_lines lines, so a long monologue is counted and not collected.
    """
    worded = (X.stripped("text") != "") & ~X.is_media_only("text")
    rows = with_runs(m, size=None).withColumns({"worded": worded, "line": X.stripped("text"), "blocked": (F.col("reply_to") != "") | X.has_unresolved_reply("text")})
    rank = F.sum(F.col("worded").cast("long")).over(in_order("session_id", "run_id"))
    rows = rows.withColumn("rank", rank)
    kept = F.when(F.col("worded") & (F.col("rank") <= most_lines), F.struct("seq", "line"))
    run = rows.groupBy("conv_id", "session_id", "run_id", "speaker").agg(
        F.max("blocked").alias("blocked"), F.count_if("worded").alias("n"), F.sum(F.when(F.col("worded"), F.length("line")).otherwise(0)).alias("chars"),
        F.array_sort(F.collect_list(kept)).alias("kept"),
    )
    run = run.withColumns({"lines": F.col("kept.line"), "numbers": F.col("kept.seq"), "fits": ~F.col("blocked") & F.col("n").between(1, most_lines) & (F.col("chars") <= most_chars)})
    w = Window.partitionBy("conv_id", "session_id").orderBy("run_id")
    pairs = run.withColumn("next", F.lead(F.struct("speaker", "fits", "lines", "numbers")).over(w)).join(sides, "conv_id")
    pairs = pairs.where((F.col("speaker") == F.col("counterpart")) & (F.col("next.speaker") == F.col("target")) & F.col("fits") & F.col("next.fits"))
    return pairs.select("conv_id", "session_id", F.col("lines").alias("incoming"), F.col("next.lines").alias("reply"), F.col("numbers").alias("incoming_messages"), F.col("next.numbers").alias("reply_messages"), F.lit("adjacent").alias("pairing"))


def explicit(m: DataFrame, sides: DataFrame, most_lines: int = 3, most_chars: int = 80, gap_minutes: int = L.SESSION_GAP_MINUTES) -> DataFrame:
    """Replies that name their message: a unique earlier id of the counterpart's, which is no reply itself.

    The reply goes on while the target keeps talking near it; more than most_lines messages reject it.
    """
    w = in_order()
    rows = with_runs(m, size=None).withColumn("plain", (F.col("reply_to") == "") & ~X.has_unresolved_reply("text"))
    after = [F.lead(F.struct("speaker", "plain", "ts", "text", "seq"), k).over(w) for k in range(1, most_lines + 1)]
    rows = rows.withColumns({f"after{k}": a for k, a in enumerate(after, 1)})
    ids = m.where("source_id <> ''").groupBy("conv_id", "source_id").agg(
        F.count("*").alias("n"), F.first("seq").alias("source_seq"), F.first("speaker").alias("source_speaker"), F.first("text").alias("source_text"), F.first("reply_to").alias("source_reply"),
    ).where("n = 1")
    hit = rows.where("reply_to <> ''").join(sides, "conv_id").where("speaker = target").join(ids.drop("n").withColumnRenamed("source_id", "reply_to"), ["conv_id", "reply_to"])
    hit = hit.where((F.col("source_seq") < F.col("seq")) & (F.col("source_speaker") == F.col("counterpart")) & (F.col("source_reply") == "") & ~X.has_unresolved_reply("source_text"))
    goes_on: list[Column] = []
    for k in range(1, most_lines + 1):
        a = F.col(f"after{k}")
        gap = minutes_between(a["ts"], F.col("ts"))
        near = a["ts"].isNull() | F.col("ts").isNull() | gap.between(0, gap_minutes)
        ok = F.coalesce((a["speaker"] == F.col("target")) & a["plain"] & near, F.lit(False))
        goes_on.append(goes_on[-1] & ok if goes_on else ok)
    more = F.filter(F.array(*(F.when(g, F.struct(F.col(f"after{k}.text").alias("text"), F.col(f"after{k}.seq").alias("seq"))) for k, g in enumerate(goes_on, 1))), lambda x: x.isNotNull())
    hit = hit.withColumns({"more": more, "first": X.reply_text("text")}).where(F.size("more") < most_lines)
    hit = hit.select(
        "conv_id", "session_id", F.array("source_text").alias("incoming"), F.concat(F.array("first"), F.col("more.text")).alias("reply"),
        F.array("source_seq").alias("incoming_messages"), F.concat(F.array("seq"), F.col("more.seq")).alias("reply_messages"), F.lit("explicit_reference").alias("pairing"),
    )
    said = F.concat("incoming", "reply")
    short = (F.length(F.array_join("incoming", "")) <= most_chars) & (F.length(F.array_join("reply", "")) <= most_chars)
    return hit.where(F.forall(said, lambda t: (t != "") & ~X.is_media_only(t)) & short)


def exchanges(m: DataFrame, sides: DataFrame, most_lines: int = 3, most_chars: int = 80) -> DataFrame:
    """Adjacent and explicit pairs; order them by the first reply number."""
    return adjacent(m, sides, most_lines, most_chars).unionByName(explicit(m, sides, most_lines, most_chars))


def situation(incoming: Column, reply: Column, situations: Sequence[tuple[str, str, str, str]] = L.SITUATIONS) -> Column:
    """struct<label, action> of the first situation whose two patterns match; everyday without action otherwise."""
    answer = lambda label, action: F.struct(F.lit(label).alias("label"), F.lit(action).alias("action"))
    out = F.when(X.has_unresolved_reply(incoming) | X.has_unresolved_reply(reply), answer(L.EVERYDAY, ""))
    for label, left, right, action in situations:
        out = out.when(incoming.rlike(left) & reply.rlike(right), answer(label, action))
    return out.otherwise(answer(L.EVERYDAY, ""))


def classified(pairs: DataFrame, situations: Sequence[tuple[str, str, str, str]] = L.SITUATIONS) -> DataFrame:
    s = situation(F.array_join("incoming", " "), F.array_join("reply", " "), situations)
    return pairs.withColumn("s", s).select("*", "s.label", "s.action").drop("s")


def input_situation(text: Column, situations: Sequence[tuple[str, str, str, str]] = L.SITUATIONS) -> Column:
    """The only situation whose incoming pattern matches, else null."""
    hits = F.array_compact(F.array(*(F.when(text.rlike(left), label) for label, left, _, _ in situations)))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def ranked_situations(pairs: DataFrame) -> DataFrame:
    """Per conversation the situations with an action, by the number of sessions they occur in."""
    by = pairs.where("action <> ''").groupBy("conv_id", "label").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("pairs"), F.min(F.get("reply_messages", F.lit(0))).alias("first"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("sessions"), "first")))


def selected(pairs: DataFrame, limit: int = 8, by: Sequence[str] = ("conv_id",)) -> DataFrame:
    """The chosen pairs of each conversation (or other group) with their rank.

    Equal pairs count once, with their first place. Each pick is worth 3 for an action, 2 for the share of its reply's
    characters that no earlier pick has, up to 1 for length, less 3 for each earlier pick of its label and 2 for each
    of its session; ties go to the earlier pair. A pick is one aggregation over all pairs, in the JVM; between picks
    only what was chosen is kept, so a long conversation is never in memory.
    """
    by, place = list(by), F.get("reply_messages", F.lit(0))
    columns = F.struct(*pairs.columns)
    once = pairs.groupBy(*by, F.col("incoming").alias("__in"), F.col("reply").alias("__out")).agg(F.min_by(columns, place).alias("pair"), F.min(place).alias("at"))
    said = F.array_join("pair.reply", "")
    worth = F.when(F.col("pair.action") != "", 3).otherwise(0)
    rows = once.select(*by, "pair", "at", worth.alias("worth"), F.array_distinct(F.regexp_extract_all(said, F.lit("(?s)."), F.lit(0))).alias("signs"), (F.least(F.length(said), F.lit(30)) / 30.0).alias("long"))
    pick = F.struct("at", "pair", "signs")
    chosen = rows.select(*by).distinct().withColumn("chosen", F.array().cast(f"array<{rows.select(pick.alias('x')).schema['x'].dataType.simpleString()}>"))
    for _ in range(max(0, limit)):
        each = rows.join(chosen, by)
        new = F.size(F.array_except("signs", F.flatten(F.col("chosen.signs"))))
        again = lambda of: F.size(F.filter("chosen", lambda c: c["pair"][of] == F.col("pair")[of]))
        score = F.col("worth") + 2 * (new / F.greatest(F.size("signs"), F.lit(1))) + F.col("long") - 3 * again("label") - 2 * again("session_id")
        open_ = ~F.array_contains("chosen.at", F.col("at"))
        best = F.max_by(pick, F.when(open_, F.struct(score, -F.col("at"))))
        chosen = each.groupBy(*by).agg(F.any_value("chosen").alias("chosen"), best.alias("best"))
        chosen = chosen.select(*by, F.concat("chosen", F.array_compact(F.array("best"))).alias("chosen"))
    return chosen.select(F.posexplode("chosen").alias("rank", "x")).select("x.pair.*", (F.col("rank") + 1).cast("long").alias("rank"))


def demonstrations(pairs: DataFrame, limit: int = 8) -> DataFrame:
    """Chosen pairs as lines of a demonstration: conv_id, rank, shown."""
    wrap = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("「"), x, F.lit("」"))), "")
    return selected(pairs, limit).select("conv_id", "rank", F.concat(F.lit("对方："), wrap("incoming"), F.lit(" → 我："), wrap("reply")).alias("shown"))


def chat_turns(turns: DataFrame, most: int = 20, asking: str = "user") -> DataFrame:
    """The last turns of each conversation (conv_id, turn, role, text) that aren't blank, up to the last one of the asking side."""
    w = Window.partitionBy("conv_id")
    said = turns.where(X.stripped("text") != "").withColumn("__last", F.max(F.when(F.col("role") == asking, F.col("turn"))).over(w)).where("turn <= __last")
    return said.withColumn("__n", F.row_number().over(w.orderBy(F.desc("turn")))).where(F.col("__n") <= most).drop("__last", "__n")


def looked_up(rows: DataFrame, by: DataFrame, key: str, defaults: Mapping[str, Column]) -> DataFrame:
    """rows with the columns of a look-up table that has each key once; a key that isn't there gets the defaults."""
    out = rows.join(by, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def signals(pairs: DataFrame, most: int = 6) -> DataFrame:
    """Per situation the most frequent tokens of what came in; ties in code-point order."""
    words = pairs.where("action <> ''").select("conv_id", "label", F.explode(F.regexp_extract_all(F.array_join("incoming", " "), F.lit(L.SIGNAL_TOKEN), F.lit(0))).alias("token"))
    by = words.where(~F.col("token").isin(*L.SIGNAL_STOP)).groupBy("conv_id", "label", "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("conv_id", "label").orderBy(F.desc("n"), "token")
    top = by.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return top.groupBy("conv_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("signals"))


def scenarios(pairs: DataFrame, limit: int = 12, most_examples: int = 3, situations: Sequence[tuple[str, str, str, str]] = L.SITUATIONS) -> DataFrame:
    """One row per conversation and situation: signals, patterns, move, examples, confidence, sessions."""
    acted = pairs.where("action <> ''")
    groups = acted.groupBy("conv_id", "label").agg(F.first("action").alias("response_move"), F.count_distinct("session_id").alias("sessions"))
    groups = groups.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("sessions"), "label"))).where(F.col("rank") <= limit)
    picked = selected(acted, most_examples, ("conv_id", "label"))
    examples = picked.groupBy("conv_id", "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "incoming", "reply", "session_id", "incoming_messages", "reply_messages", "pairing"))), lambda x: x.dropFields("rank")).alias("examples")
    )
    ids = F.create_map(*(F.lit(x) for kv in L.SCENARIO_IDS.items() for x in kv))
    pattern = lambda k: F.coalesce(*(F.when(F.col("label") == s[0], F.lit(s[k])) for s in situations))
    return groups.join(examples, ["conv_id", "label"]).join(signals(pairs), ["conv_id", "label"], "left").select(
        "conv_id", F.coalesce(ids[F.col("label")], F.lit("scenario")).alias("id"), "label", F.coalesce("signals", F.array().cast("array<string>")).alias("signals"),
        pattern(1).alias("trigger_pattern"), pattern(2).alias("reply_pattern"), "response_move", "examples",
        F.when(F.col("sessions") > 1, "repeated_observation").otherwise("single_observation").alias("confidence"), "sessions", "rank",
    )


def routed(inputs: DataFrame, routes: DataFrame, situations: Sequence[tuple[str, str, str, str]] = L.SITUATIONS) -> DataFrame:
    """The best scenario of each input (id, conv_id, text) of the same conversation; distress has none.

    Score: length of the signals contained, and 2 where the stored pattern matches; ties go to the first route.
    """
    text, label = F.col("text"), F.col("label")
    current = F.coalesce(*(F.when(label == s[0], text.rlike(s[1])) for s in situations), F.lit(True))
    score = F.aggregate(F.filter("signals", lambda s: text.contains(s)), F.lit(0), lambda a, s: a + F.length(s)) + F.when((F.col("trigger_pattern") != "") & F.expr("text rlike trigger_pattern"), 2).otherwise(0)
    hits = inputs.where(~text.rlike(L.DISTRESS)).join(routes.select("conv_id", F.col("id").alias("scenario"), "label", "signals", "trigger_pattern", "response_move", "rank"), "conv_id")
    hits = hits.where(current).withColumn("score", score).where("score > 0")
    return hits.groupBy("conv_id", "id").agg(F.min_by(F.struct("scenario", "label", "response_move", "score"), F.struct(-F.col("score"), "rank")).alias("r")).select("conv_id", "id", "r.*")


def coverage(pairs: DataFrame, routes: DataFrame, m: DataFrame, sides: DataFrame, situations: Sequence[tuple[str, str, str, str]] = L.SITUATIONS) -> DataFrame:
    """Per conversation and situation: covered (two sessions with examples), evidence_insufficient or missing_response."""
    said = m.join(sides, "conv_id").where("speaker = counterpart").select("conv_id", F.explode(F.array_compact(F.array(*(F.when(F.col("text").rlike(s[1]), F.lit(s[0])) for s in situations)))).alias("label"))
    inputs = said.groupBy("conv_id", "label").agg(F.count("*").alias("observed_inputs"))
    names = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(s[0]).alias("label")) for k, s in enumerate(situations))))
    grid = sides.select("conv_id", names.alias("x")).select("conv_id", "x.*")
    out = grid.join(routes.select("conv_id", "label", "sessions", F.size("examples").alias("examples"), "response_move"), ["conv_id", "label"], "left").join(inputs, ["conv_id", "label"], "left")
    seen = F.coalesce("observed_inputs", F.lit(0))
    status = (
        F.when(F.coalesce("examples", F.lit(0)) == 0, F.when((seen > 0) | F.col("sessions").isNotNull(), "missing_response").otherwise("evidence_insufficient"))
        .when(F.col("sessions") < 2, "evidence_insufficient").otherwise("covered")
    )
    return out.select("conv_id", "place", "label", status.alias("status"), F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("examples", F.lit(0)).alias("examples"), seen.alias("observed_inputs"), F.coalesce("response_move", F.lit("")).alias("response_move"))


def pack(units: Sequence[str], limit: int, bins: int, separator: str = "\n\n---\n\n") -> tuple[list[str], int]:
    """Whole units, the longest first, into the first of `bins` strings of at most `limit` characters that has room.

    Returns the strings, in the order of their first units, and the number of units that found no room.
    """
    texts = dict(enumerate(t for u in units if (t := u.strip())))
    # a unit takes its separator along, for which each string has room once more
    room = [limit + len(separator)] * max(0, bins)
    placed: dict[int, int] = {}
    for i, text in sorted(texts.items(), key=lambda x: len(x[1]), reverse=True):
        need = len(text) + len(separator)
        for k, free in enumerate(room):
            if need <= free:
                placed[i], room[k] = k, free - need
                break
    strings: dict[int, list[str]] = {}
    for i in sorted(placed):
        strings.setdefault(placed[i], []).append(texts[i])
    return [separator.join(s) for s in strings.values()], len(texts) - len(placed)
