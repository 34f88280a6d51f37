"""The reference layer of a pack: topics with their lines, conclusions beside what was said, a guide, all within a budget of bytes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.operators import evidence as V
from talkframe.operators import mining as N
from talkframe.operators import packs as K
from talkframe.operators import scans


def named(column: Column, names: Mapping[str, str]) -> Column:
    """A value's name, or the value itself."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[column], column)


def joined_lines(rows: DataFrame, order: list[str], line: str = "line", by: str = "conv_id") -> DataFrame:
    """One text a conversation from its lines in order."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: x[line]), "\n").alias("markdown"))


def topic_excerpts(m: DataFrame, topics: DataFrame, want: int = 12) -> DataFrame:
    """Timed messages that hold a topic (conv_id, gram, rank), at most `want` at even distances: conv_id, gram, rank, seq, ts, speaker, text."""
    timed = m.where("ts IS NOT NULL").select("conv_id", "seq", "ts", "speaker", "text")
    hits = N.standing_in(topics.select("conv_id", "gram", "rank"), timed, "gram", "text").dropDuplicates(["conv_id", "gram", "seq"])
    return N.strided(hits, ["seq"], ["conv_id", "gram"], want)


def topic_document(m: DataFrame, topics: DataFrame, want: int = 12) -> DataFrame:
    """One Markdown text a conversation: a heading a topic with its count, months and speakers, and its lines."""
    found = topic_excerpts(m, topics, want)
    month = F.date_format("ts", "yyyy-MM")
    heads = found.groupBy("conv_id", "gram", "rank").agg(F.count("*").alias("n"), F.min(month).alias("first"), F.max(month).alias("last"))
    said = found.groupBy("conv_id", "gram", "speaker").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    who = N.most_common(said, ["conv_id", "gram"], 3, "seq").groupBy("conv_id", "gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "speaker", "n"))), lambda x: F.concat(x["speaker"], F.lit(" "), x["n"].cast("string"), F.lit(" 条"))), "、").alias("who"))
    span = F.when(F.col("n") > 1, F.concat_ws(" ~ ", "first", "last")).otherwise(F.col("first"))
    counts = topics.select("conv_id", "gram", F.col("n").alias("times"))
    heads = heads.join(counts, ["conv_id", "gram"]).join(who, ["conv_id", "gram"])
    head = F.concat(F.lit("## 「"), "gram", F.lit("」（提到 "), F.col("times").cast("string"), F.lit(" 次，"), span, F.lit("）\n\n> 抽样 "), F.col("n").cast("string"), F.lit(" 条；发言人："), "who", F.lit("\n"))
    lines = found.select("conv_id", "rank", F.col("seq").alias("place"), F.concat(F.lit("- "), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" "), "speaker", F.lit("："), X.squeezed("text")).alias("line"))
    rows = heads.select("conv_id", "rank", F.lit(-1).cast("long").alias("place"), head.alias("line")).unionByName(lines.withColumn("place", F.col("place").cast("long")))
    title = rows.select("conv_id").distinct().select("conv_id", F.lit(0).cast("int").alias("rank"), F.lit(-2).cast("long").alias("place"), F.lit(L.TOPICS_TITLE + "\n").alias("line"))
    return joined_lines(rows.withColumn("rank", F.col("rank").cast("int")).unionByName(title), ["rank", "place"])


def evidence_rows(items: DataFrame, m: DataFrame) -> DataFrame:
    """Claims of items (conv_id, item_id, section, text) with status, score, nearest line and its neighbours; claim_no -1 where an item has none."""
    order = Window.partitionBy("conv_id").orderBy("item_id", "claim_no")
    claims = V.claims_of(items.select("conv_id", "item_id", "section", "text")).withColumn("claim_id", F.row_number().over(order).cast("long"))
    found = V.verified(claims.select("conv_id", "claim_id", "claim"), m)
    lines = V.corpus_lines(m)
    near = scans.around(lines.select("conv_id", "raw", "line_id"), "raw", ["conv_id"], ["line_id"], scans.by_number("line_id"))
    near = near.groupBy("conv_id", F.col("raw").alias("nearest")).agg(F.min_by(F.struct("before", "after"), "line_id").alias("around"))
    # a claim found word for word is shown with the line that holds it, where one line does
    exact = V.quoting(claims.select("conv_id", F.col("claim_id").alias("item_id"), "claim"), lines.select("conv_id", F.col("line_id").alias("seq"), F.col("raw").alias("text")))
    exact = exact.groupBy("conv_id", F.col("item_id").alias("claim_id")).agg(F.min_by("text", "seq").alias("holds"))
    out = claims.join(found.drop("claim"), ["conv_id", "claim_id"]).join(exact, ["conv_id", "claim_id"], "left")
    out = out.withColumn("nearest", F.coalesce(F.nullif("nearest", F.lit("")), "holds", F.lit(""))).join(near, ["conv_id", "nearest"], "left")
    none = items.join(claims.select("conv_id", "item_id").distinct(), ["conv_id", "item_id"], "left_anti")
    bare = none.select("conv_id", "item_id", "section", "text", F.lit(-1).alias("claim_no"), F.lit("").alias("claim"), F.lit("none").alias("status"), F.lit(0.0).alias("score"), F.lit("").alias("nearest"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    return out.select("conv_id", "item_id", "section", "text", "claim_no", "claim", "status", "score", "nearest", F.col("around.before").alias("before"), F.col("around.after").alias("after")).unionByName(bare)


def evidence_document(rows: DataFrame) -> DataFrame:
    """One Markdown text a conversation from evidence_rows: sections, items, and under each what was said."""
    unsaid = (F.col("status").isin("none", "skip")) | (F.col("nearest") == "")
    mark = F.concat(F.lit("  - "), named(F.col("status"), L.EVIDENCE_MARKS), F.lit(" "), F.format_string("%.2f", "score"), F.lit("：「"), "nearest", F.lit("」"))
    around = F.array_join(F.transform(F.array_compact(F.array("before", "after")), lambda x: F.concat(F.lit("\n    - 上下文："), x)), "")
    line = F.when(unsaid, F.lit("  - （没有直接原话可对：属于统计口径或概括）")).otherwise(F.concat(mark, around))
    body = rows.groupBy("conv_id", "section", "item_id", "text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("said"))
    items = body.groupBy("conv_id", "section").agg(
        F.min("item_id").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", F.concat(F.lit("- **"), X.stripped("text"), F.lit("**\n"), "said").alias("line")))), lambda x: x["line"]), "\n").alias("lines"),
    )
    return joined_lines(items.select("conv_id", "first", F.concat(F.lit("## "), "section", F.lit("\n\n"), "lines", F.lit("\n")).alias("line")), ["first"]).withColumn("markdown", F.concat(F.lit(L.EVIDENCE_TITLE + "\n\n"), "markdown"))


def assembled(documents: DataFrame, m: DataFrame, budget: int, redact: bool = True, sources: DataFrame | None = None, source_cap: int = L.SOURCE_CAP_BYTES) -> DataFrame:
    """Files of the layer (conv_id, path, body, bytes): the documents (conv_id, path, body) that aren't empty, and the newest months of the transcript that the budget still holds.

    sources: conv_id, name, body, the texts of original exports. Each up to source_cap bytes goes along, and takes nothing of the
    budget; larger ones are named in the guide, empty and null ones aren't. What fits is decided on the texts as they are, and only
    months that fit are built. Texts are redacted after that; sizes in the guide and in `bytes` are those of what is written.
    """
    clean = (lambda c: X.redacted(c)) if redact else (lambda c: c)
    docs = documents.where(X.stripped("body") != "").select("conv_id", "path", "body")
    spent = docs.groupBy("conv_id").agg(F.sum(F.octet_length("body").cast("long")).alias("spent"))
    kept = K.fitting(K.months(m).select("conv_id", "month", "bytes"), spent, budget)
    lines = K.transcript_lines(m).join(kept.where("kept").select("conv_id", "month"), ["conv_id", "month"], "left_semi")
    months = lines.groupBy("conv_id", "month").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    body = F.concat(F.lit("# "), "month", F.lit("（"), F.col("n").cast("string"), F.lit(" 条）\n\n"), "lines", F.lit("\n"))
    files = docs.unionByName(months.select("conv_id", F.concat(F.lit("transcript/"), "month", F.lit(".md")).alias("path"), body.alias("body")))
    left = kept.where("not kept").select("conv_id", F.col("month").alias("left"))
    if sources is not None:
        size = F.octet_length("body").cast("long")
        files = files.unionByName(sources.where(size.between(1, source_cap)).select("conv_id", F.concat(F.lit("source/"), "name").alias("path"), "body"))
        left = left.unionByName(sources.where(size > source_cap).select("conv_id", F.concat("name", F.lit("（"), size.cast("string"), F.lit("）")).alias("left")))
    files = files.withColumn("body", clean(F.col("body"))).withColumn("bytes", F.octet_length("body").cast("long"))
    listing = files.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "bytes"))), lambda x: F.concat(F.lit("- `"), x["path"], F.lit("` "), x["bytes"].cast("string"))), "\n").alias("list"))
    out = left.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("left")), "、").alias("left"))
    guide = listing.join(out, "conv_id", "left").select("conv_id", F.lit("README.md").alias("path"), F.concat(F.lit(L.GUIDE_TITLE + "\n\n"), "list", F.when(F.coalesce("left", F.lit("")) != "", F.concat(F.lit("\n\n> "), "left")).otherwise(""), F.lit("\n")).alias("body"))
    return files.unionByName(guide.withColumn("bytes", F.octet_length("body").cast("long")))


def coverage_markdown(coverage: DataFrame) -> DataFrame:
    """One Markdown text a conversation of exchanges.coverage."""
    line = F.concat(F.lit("- "), "label", F.lit("："), named(F.col("status"), L.COVERAGE_LABELS), F.lit("；会话 "), F.col("sessions").cast("string"), F.lit(" 段；示例 "), F.col("examples").cast("string"), F.lit(" 个；接法 "), F.coalesce(F.nullif("response_move", F.lit("")), F.lit("待补标")))
    return joined_lines(coverage.select("conv_id", "place", line.alias("line")), ["place"]).withColumn("markdown", F.concat(F.lit(L.COVERAGE_TITLE + "\n\n"), "markdown"))


def specificity_markdown(specificity: DataFrame, items: DataFrame) -> DataFrame:
    """One Markdown text a conversation of evidence.specificity, with the items' texts."""
    rows = specificity.join(items.select("conv_id", "item_id", "text").distinct(), ["conv_id", "item_id"])
    line = F.concat(F.lit("- "), "text", F.lit("："), F.col("score").cast("string"), F.lit("/100；原话 "), F.col("quotes").cast("string"), F.lit(" 条；会话 "), F.col("sessions").cast("string"), F.lit(" 段；泛化风险 "), "risk")
    return joined_lines(rows.select("conv_id", "item_id", line.alias("line")), ["item_id"]).withColumn("markdown", F.concat(F.lit(L.SPECIFICITY_TITLE + "\n\n"), "markdown"))


def sections_markdown(items: DataFrame, title: str, notes: Mapping[str, str] | None = None) -> DataFrame:
    """A document (skill, memory, observations) from items (conv_id, place, section, ordinal, text): its title, sections in order, a note under those that have one."""
    note = F.coalesce(F.create_map(*(F.lit(x) for kv in (notes or {"": ""}).items() for x in kv))[F.col("section")], F.lit(""))
    lines = items.groupBy("conv_id", "place", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: F.concat(F.lit("- "), X.squeezed(x["text"]))), "\n").alias("lines"))
    body = F.concat(F.lit("## "), "section", F.lit("\n\n"), F.when(note != "", F.concat(F.lit("> "), note, F.lit("\n\n"))).otherwise(""), "lines", F.lit("\n"))
    return joined_lines(lines.select("conv_id", "place", body.alias("line")), ["place"]).withColumn("markdown", F.concat(F.lit(f"# {title}\n\n"), "markdown"))


def memory_markdown(ledger: DataFrame, items: DataFrame) -> DataFrame:
    """Memories by section with their state: a document from evidence.ledger and the items it was made of."""
    rows = ledger.join(items.select("conv_id", "item_id", "text").distinct(), ["conv_id", "item_id"])
    first = Window.partitionBy("conv_id", "section")
    text = F.concat("text", F.lit("（"), named(F.col("status"), L.STATUS_LABELS), F.coalesce(F.concat(F.lit("，"), "time_start"), F.lit("")), F.lit("）"))
    return sections_markdown(rows.select("conv_id", F.min("item_id").over(first).alias("place"), "section", F.col("item_id").alias("ordinal"), text.alias("text")), "memory")


def identity(description: Column) -> Column:
    """What is said of who somebody is: the user's description, marked as unchecked, or a fixed notice."""
    given = X.stripped(F.coalesce(description, F.lit("")))
    before, after = L.IDENTITY_GIVEN.split("{0}")
    return F.when(given != "", F.concat(F.lit(before), given, F.lit(after))).otherwise(F.lit(L.IDENTITY_NOTICE))


def unwrapped(text: Column) -> Column:
    """A reply without hard breaks: two or three lines stay, more become one line, with a blank between them unless CJK characters meet."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n"), X.stripped), lambda x: x != "")
    one = F.regexp_replace(F.array_join(lines, "\n"), rf"(?<=[{L.CJK_RANGES}])\n|\n(?=[{L.CJK_RANGES}])", "")
    return F.when(F.size(lines).between(2, 3), F.array_join(lines, "\n")).otherwise(F.regexp_replace(one, "\n", " "))


def usable_example(incoming: Column, reply: Column) -> Column:
    """Whether an exchange (two arrays of lines) may serve as an example: short, clean, and not only tags."""
    least, most_in, most_out, lines = L.EXAMPLE_LIMITS
    mine, theirs = F.array_join(incoming, "\n"), F.array_join(reply, "\n")
    bare = lambda t, n: F.length(X.stripped(F.regexp_replace(t, r"\[[^\[\]]*\]", ""))) >= n
    fits = F.length(mine).between(least, most_in) & (F.length(theirs) <= most_out) & F.size(reply).between(1, lines) & (F.size(incoming) > 0)
    bad = r"\[(?:" + "|".join(L.EXAMPLE_BAD_MARKS) + r")\]"
    clean = ~mine.rlike(bad) & ~theirs.rlike(bad)
    return fits & clean & bare(mine, 3) & bare(theirs, 2) & F.forall(reply, lambda x: X.stripped(x) != "")


def envelope(routes: DataFrame) -> DataFrame:
    """Hints of routed inputs (conv_id, id, label, response_move) for a prompt."""
    return routes.select("conv_id", "id", F.concat(F.lit(L.CURRENT_SITUATION + "\n"), "label", F.lit("："), "response_move").alias("hint"))


def json_length(text: Column) -> Column:
    """Characters of a text as a JSON string, with what isn't ASCII as it is."""
    short, control = F.regexp_count(text, F.lit(r'["\\\x08\t\n\f\r]')), F.regexp_count(text, F.lit(r"[\x00-\x07\x0B\x0E-\x1F]"))
    return F.length(text) + 2 + short + 5 * control


def round_robin(items: DataFrame, budget: int) -> DataFrame:
    """Whole items (conv_id, section, section_place, ordinal, batch, text) that a JSON of all batches' drafts has room for.

    Section by section the batches take turns with their items; one that would make the JSON longer than the budget is
    left out, and shorter ones behind it may still fit. Batches are numbered from 0, and each has an object, be it empty.
    Items of a conversation stream past in order; no more than the batches' states is held.
    """
    rows = items.select("conv_id", "section_place", "ordinal", "batch", json_length(F.col("text")).alias("size"), json_length(F.col("section")).alias("name"))
    batches = items.groupBy("conv_id").agg((F.max("batch") + 1).cast("long").alias("batches"))
    order = ["conv_id", "section_place", "ordinal", "batch"]
    laid = rows.join(batches.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    laid = laid.withColumn("key", F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("c"), F.coalesce("conv_id", F.lit(""))))
    dealt = laid.repartition("key").sortWithinPartitions("key", *order[1:])

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = place = None
        used, started, opened = 0, set(), set()
        for part in parts:
            kept = []
            columns = zip(*(part[c].tolist() for c in ("key", "section_place", "batch", "size", "name", "batches")), strict=True)
            for k, p, batch, size, name, n in columns:
                if k != key:
                    key, place, started, used = k, None, set(), 2 * n + 2 * n  # brackets and commas of the list, braces
                if p != place:
                    place, opened = p, set()
                more = size + (2 if batch in opened else name + 4 + (2 if batch in started else 0))
                kept.append(used + more <= budget)
                if kept[-1]:
                    used += more
                    opened.add(batch)
                    started.add(batch)
            yield part.loc[kept, ["conv_id", "section_place", "ordinal", "batch"]]

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in order)
    chosen = dealt.mapInPandas(walk, kinds)
    return items.join(chosen.withColumnsRenamed({c: f"__{c}" for c in order}), reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in order)), "left_semi")
