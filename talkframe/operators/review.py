"""Evaluation cases, feedback, questions, decisions and the quality gate of observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators import evidence as V
from talkframe.operators.exchanges import routed, situation


def case_issue(prompt: Column, replies: Column, label: Column, origin: Column, situations: Sequence[tuple[str, str, str, str]] = L.SITUATIONS) -> Column:
    """Why a case can't be used: unresolved_reference, no_trigger or unsupported_reply; null if it can."""
    fits = F.coalesce(*(F.when(label == s[0], prompt.rlike(s[1])) for s in situations), F.lit(True))
    known = label.isin(*(s[0] for s in situations))
    same = situation(prompt, F.array_join(replies, " "), situations)["label"] == label
    unresolved = X.has_unresolved_reply(prompt) | F.exists(replies, X.has_unresolved_reply)
    return F.when(F.coalesce(origin, F.lit("")).isin("feedback", "holdout"), None).when(unresolved, "unresolved_reference").when(known & ~fits, "no_trigger").when(known & (F.size(replies) > 0) & ~same, "unsupported_reply")


def cases(scenarios: DataFrame, most: int = 3, limit: int = 30, situations: Sequence[tuple[str, str, str, str]] = L.SITUATIONS) -> DataFrame:
    """Regression cases from the first examples of each scenario, without those that have an issue."""
    rows = scenarios.select("conv_id", F.col("id").alias("scenario_id"), "label", "response_move", "rank", F.posexplode(F.slice("examples", 1, most)).alias("pos", "e"))
    rows = rows.select(
        "conv_id", F.concat("scenario_id", F.lit("-"), (F.col("pos") + 1).cast("string")).alias("id"), "scenario_id", "label", F.array_join("e.incoming", " ").alias("prompt"),
        F.col("response_move").alias("expected_move"), F.col("e.reply").alias("allowed_quotes"), F.col("e.pairing").alias("pairing"), F.lit(None).cast("string").alias("origin"), "rank", "pos",
    )
    rows = rows.where(case_issue(F.col("prompt"), F.col("allowed_quotes"), F.col("label"), F.col("origin"), situations).isNull())
    w = Window.partitionBy("conv_id").orderBy("rank", "pos")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("rank", "pos")


def pooled_cases(packaged: DataFrame, feedback: DataFrame, most: int = 50) -> DataFrame:
    """Packaged cases, then negative feedback (conv_id, seq, user, label), newest first, one a prompt."""
    bad = feedback.where(F.col("label").isin(*L.CORRECTIONS))
    moves = F.create_map(*(F.lit(x) for kv in L.CORRECTIONS.items() for x in kv))
    newest = bad.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "user").orderBy(F.desc("seq")))).where("n = 1")
    fresh = newest.join(packaged.select("conv_id", F.col("prompt").alias("user")).distinct(), ["conv_id", "user"], "left_anti")
    own = packaged.select("conv_id", "id", "prompt", "expected_move", F.coalesce("origin", F.lit("package")).alias("origin"), F.lit(0).alias("part"), F.col("n").cast("long").alias("place"))
    more = fresh.select("conv_id", F.concat(F.lit("feedback-"), F.left(F.sha2(F.concat("seq", "user").cast("binary"), 256), F.lit(16))).alias("id"), F.col("user").alias("prompt"), moves[F.col("label")].alias("expected_move"), F.lit("feedback").alias("origin"), F.lit(1).alias("part"), (-F.col("seq")).cast("long").alias("place"))
    both = own.unionByName(more).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "place")))
    return both.where(F.col("n") <= most).drop("part", "place")


def checked(case_rows: DataFrame, replies: DataFrame, routes: DataFrame, situations: Sequence[tuple[str, str, str, str]] = L.SITUATIONS, forbidden: Sequence[str] = ()) -> DataFrame:
    """Static check of replies (conv_id, id, reply) to cases: reasons, passed, and whether an allowed quote occurs."""
    to = routed(case_rows.select("conv_id", "id", F.col("prompt").alias("text")), routes, situations).select("conv_id", "id", F.col("scenario").alias("routed"))
    rows = case_rows.join(replies, ["conv_id", "id"], "left").join(to, ["conv_id", "id"], "left")
    text = X.stripped(F.coalesce("reply", F.lit("")))
    reasons = F.array_compact(F.array(
        F.when(text == "", "empty"), F.when(X.any_of(text, L.SERVICE_PHRASES), "service_phrase"), F.when(X.any_of(text, forbidden) if forbidden else F.lit(False), "forbidden"),
        F.when(F.col("routed").isNotNull() & (F.col("routed") != F.col("scenario_id")), "other_scenario"),
    ))
    grounded = F.exists("allowed_quotes", lambda q: (q != "") & text.contains(q))
    done = F.col("reply").isNotNull()
    return rows.select("conv_id", "id", done.alias("checked"), F.when(done, F.size(reasons) == 0).alias("passed"), F.when(done, reasons).alias("reasons"), F.when(done, F.coalesce(grounded, F.lit(False))).alias("quote_grounded"))


def totals(results: DataFrame) -> DataFrame:
    return results.groupBy("conv_id").agg(F.count("*").alias("total"), F.count_if("checked").alias("checked"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Rows a label, and among the failed ones rows a scenario."""
    label = F.when(F.col("label").isin(*L.FEEDBACK_LABELS), F.col("label")).otherwise("其他")
    kinds = feedback.groupBy("conv_id", label.alias("key")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("label"))
    failed = feedback.where(F.col("label").isin(*L.CORRECTIONS)).groupBy("conv_id", F.coalesce(F.nullif("scenario_id", F.lit("")), F.lit("未分类")).alias("key")).agg(F.count("*").alias("n"))
    return kinds.unionByName(failed.withColumn("kind", F.lit("failed")))


def feedback_rules(feedback: DataFrame, most: int = 30) -> DataFrame:
    """The last rows with a correction or a note, as one rule a scope, redacted."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("seq"))
    moves = F.create_map(*(F.lit(x) for kv in L.CORRECTIONS.items() for x in kv))
    rows = feedback.withColumns({"n": F.row_number().over(w), "move": moves[F.col("label")], "remark": X.redacted(X.stripped(F.coalesce("note", F.lit(""))))}).where(F.col("n") <= most)
    rows = rows.where(F.col("move").isNotNull() | (F.col("remark") != ""))
    said = F.concat_ws("；", "move", F.when(F.col("remark") != "", F.concat(F.lit("用户补充："), F.left(F.regexp_replace("remark", "\n", " "), F.lit(500)))))
    scope = F.coalesce(F.nullif("scenario_id", F.lit("")), F.concat(F.lit("「"), X.redacted(F.left("user", F.lit(100))), F.lit("」")))
    return rows.groupBy("conv_id", scope.alias("scope"), said.alias("rule")).agg(F.max("seq").alias("last"))


def questions(items: DataFrame, coverage: DataFrame, ledger: DataFrame) -> DataFrame:
    """What a person should confirm: traits at risk, situations that aren't covered, memories that need it."""
    traits = items.where(F.col("risk").isin("high", "medium")).select("conv_id", F.concat(F.lit("specificity-"), F.col("item_id").cast("string")).alias("id"), F.lit("trait").alias("type"), F.col("risk").alias("priority"))
    gaps = coverage.where("status <> 'covered'").select("conv_id", F.concat(F.lit("coverage-"), "label").alias("id"), F.lit("scenario").alias("type"), F.lit("medium").alias("priority"))
    memory = ledger.where("validity = 'needs_confirmation' OR confidence = 'uncertain'").select("conv_id", F.concat(F.lit("memory-"), "id").alias("id"), F.lit("memory").alias("type"), F.when(F.col("status").isin("promise", "fact"), "high").otherwise("medium").alias("priority"))
    return traits.unionByName(gaps).unionByName(memory)


def answered(asked: DataFrame, answers: DataFrame, fingerprint: str) -> DataFrame:
    """Questions with the state of answers (id, status, note, fingerprint) given to the same content; others are pending.

    A confirmation needs a note; notes are redacted and cut at 2000 characters.
    """
    good = answers.where((F.col("fingerprint") == fingerprint) & F.col("status").isin("confirmed", "rejected", "pending")).withColumn("note", F.left(X.redacted(X.stripped(F.coalesce("note", F.lit("")))), F.lit(2000)))
    good = good.where((F.col("status") != "confirmed") | (F.col("note") != "")).select("id", "status", "note")
    return asked.join(good, "id", "left").withColumns({"status": F.coalesce("status", F.lit("pending")), "note": F.coalesce("note", F.lit(""))})


def claim_identity(target: Column, text: Column) -> Column:
    """Hash of the target and the sorted distinct quotes, or of the text without white space where there are none."""
    quoted = F.array_sort(F.array_distinct(X.quotes(text)))
    basis = F.when(F.size(quoted) > 0, F.array_join(quoted, "\n")).otherwise(F.regexp_replace(text, r"\s+", ""))
    return F.left(F.sha2(F.concat_ws("\n", target, basis).cast("binary"), 256), F.lit(24))


def decided(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Traits (conv_id, target, ordinal, text) after decisions (id, status, scope, replacement): rejected ones go, rewritten ones change.

    Kept and rewritten need a scope, rewritten a replacement; a decision without them doesn't count.
    """
    scope, new = (X.redacted(X.stripped(F.coalesce(c, F.lit("")))) for c in ("scope", "replacement"))
    good = decisions.withColumns({"scope": F.left(scope, F.lit(500)), "replacement": F.left(new, F.lit(2000))})
    good = good.where((F.col("status") == "rejected") | ((F.col("status") == "kept") & (F.col("scope") != "")) | ((F.col("status") == "rewritten") & (F.col("scope") != "") & (F.col("replacement") != "")))
    rows = items.withColumn("id", claim_identity(F.col("target"), F.col("text"))).join(good, "id", "left").where("status IS NULL OR status <> 'rejected'")
    text = F.when(F.col("status") == "rewritten", F.concat(F.lit("人工修订（适用范围："), "scope", F.lit("）："), "replacement")).when(F.col("status") == "kept", F.concat(F.lit("人工确认（适用范围："), "scope", F.lit("）："), "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "ordinal", "id", text.alias("text"))


def quoted_pairs(text: Column) -> Column:
    """array<struct<incoming, reply>> of pairs written as quotes on both sides of an arrow."""
    side = lambda k: F.transform(F.regexp_extract_all(text, F.lit(L.QUOTED_PAIR), F.lit(k)), lambda s: F.transform(F.regexp_extract_all(s, F.lit(L.QUOTED), F.lit(1)), X.stripped))
    return F.arrays_zip(side(1).alias("incoming"), side(2).alias("reply"))


def gated(items: DataFrame, m: DataFrame, target: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items (conv_id, item_id, section, text) with `why`, the reason that drops them, or null.

    Generic labels go; rules about timing, and absolute ones about tenderness; traits must quote messages, one of the
    target's among them; strategies must quote whole real pairs; phrases occur in two messages and, where all
    messages have a time, in two sessions; typical lines equal a message of the target.
    """
    from talkframe.operators.sessions import with_sessions

    t = X.stripped("text")
    rule = F.when(t.rlike(L.GENERIC_ITEM), "generic").when((F.col("section") == "硬规则") & (F.col("text").rlike(L.TIMING_RULE) | (F.col("text").rlike(L.ABSOLUTE_RULE) & F.col("text").rlike(L.ABSOLUTE_ABOUT))), "rule")
    rows = items.withColumn("rule", rule)
    quotes = items.where("section IN ('人物特点', '口头禅')").select("conv_id", "item_id", "section", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(L.QUOTED), F.lit(1)), X.stripped))).alias("claim"))
    s = with_sessions(m).join(target, "conv_id")
    s = s.withColumns({"own": F.col("speaker") == F.col("target"), "untimed": F.bool_or(F.col("ts").isNull()).over(Window.partitionBy("conv_id"))})
    key = quotes.withColumn("id", F.xxhash64("item_id", "claim"))
    found = V.quoting(key.select("conv_id", F.col("id").alias("item_id"), "claim"), s.drop("session_id")).select("conv_id", F.col("item_id").alias("id"), "seq", "own", "untimed")
    found = found.join(s.select("conv_id", "seq", "session_id"), ["conv_id", "seq"])
    per = found.groupBy("conv_id", "id").agg(F.count_if("own").alias("own"), F.count_distinct(F.when(F.col("own"), F.col("session_id"))).alias("sessions"), F.bool_or("untimed").alias("untimed"))
    per = key.join(per, ["conv_id", "id"], "left").groupBy("conv_id", "item_id").agg(
        F.bool_and(F.col("own").isNotNull()).alias("all_found"), F.bool_or(F.coalesce("own", F.lit(0)) > 0).alias("any_own"),
        F.bool_and((F.coalesce("own", F.lit(0)) >= 2) & (F.coalesce("untimed", F.lit(False)) | (F.coalesce("sessions", F.lit(0)) >= 2)) & X.is_expressive("claim")).alias("habit"),
    )
    real = pairs.select("conv_id", F.struct("incoming", "reply").alias("p")).distinct()
    told = items.where("section IN ('情境策略', '接话方式')").select("conv_id", "item_id", F.explode(quoted_pairs(F.col("text"))).alias("p"))
    told = told.join(real.withColumn("real", F.lit(True)), ["conv_id", "p"], "left").groupBy("conv_id", "item_id").agg(F.bool_and(F.coalesce("real", F.lit(False))).alias("all_real"))
    bare = lambda c: F.regexp_replace(c, "^[「」『』“”\"]+|[「」『』“”\"]+$", "")
    own = s.where("own").select("conv_id", F.col("text").alias("line")).distinct().withColumn("typical", F.lit(True))
    rows = rows.join(per, ["conv_id", "item_id"], "left").join(told, ["conv_id", "item_id"], "left").withColumn("line", bare(F.col("text"))).join(own, ["conv_id", "line"], "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    why = (
        F.when(F.col("rule").isNotNull(), F.col("rule")).when((F.col("section") == "人物特点") & (no("all_found") | no("any_own")), "no_quote").when(F.col("section").isin("情境策略", "接话方式") & no("all_real"), "no_pair")
        .when((F.col("section") == "口头禅") & no("habit"), "no_habit").when((F.col("section") == "典型例句") & no("typical"), "not_said")
        .when(F.col("section").isin("说话风格", "情感模式", "温度与分寸", "关系行为") & F.col("text").rlike(L.REPORT_LINE) & (F.size(X.quotes("text")) == 0), "report_line")
    )
    return rows.select("conv_id", "item_id", "section", "text", why.alias("why"))


def capped(items: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Items without repeats, at most so many a section, in order."""
    limits = L.SECTION_LIMITS if limits is None else limits
    first = items.groupBy("conv_id", "section", "text").agg(F.min("item_id").alias("item_id"))
    n = F.row_number().over(Window.partitionBy("conv_id", "section").orderBy("item_id"))
    most = F.coalesce(*(F.when(F.col("section") == s, k) for s, k in limits.items()))
    return first.withColumn("ordinal", n).where(most.isNull() | (F.col("ordinal") <= most))


def evidence_checks(items: DataFrame, m: DataFrame) -> DataFrame:
    """Findings of items (conv_id, item_id, section, text): quotes, dates, and both sides of `conclusion <- source`."""
    sourced = items.where(F.col("section") == L.EVIDENCE_SECTION)
    parts = F.split("text", L.CITE_ARROW, 2)
    told = sourced.where(F.size(parts) == 2).select("conv_id", "item_id", X.stripped(parts[1]).alias("claim"))
    quoted = V.claims_of(items.where(F.col("section") != L.EVIDENCE_SECTION)).select("conv_id", "item_id", "claim")
    claims = told.unionByName(quoted).withColumn("claim_id", F.xxhash64("item_id", "claim"))
    found = V.verified(claims.select("conv_id", "claim_id", "claim").distinct(), m).select("conv_id", "claim_id", "status", "score", "nearest")
    rows = claims.join(found, ["conv_id", "claim_id"]).select("conv_id", "item_id", "claim", "status", "score", "nearest")
    dates = V.date_checks(items, m).select("conv_id", "item_id", F.col("key").alias("claim"), "status", F.lit(0.0).alias("score"), F.lit("").alias("nearest"))
    return rows.where("status <> 'skip'").unionByName(dates)


def applied(items: DataFrame, findings: DataFrame, strict: bool = False) -> DataFrame:
    """Items with the marks of their findings appended, or without those that have any."""
    marks = findings.where("status <> 'verified'").groupBy("conv_id", "item_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("［"), "status", F.lit("］")))), "").alias("marks"))
    out = items.join(marks, ["conv_id", "item_id"], "left")
    out = out.where("marks IS NULL") if strict else out
    return out.withColumn("text", F.concat("text", F.coalesce("marks", F.lit("")))).drop("marks")
