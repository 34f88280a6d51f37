"""Claims against the messages they quote: find, locate, cite, check, score."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L
from talkframe.functions import text as X
from talkframe.functions.udfs import needles, nfkc_fold, ordered_coverage
from talkframe.operators import scans
from talkframe.operators.sessions import with_sessions


def corpus_lines(m: DataFrame) -> DataFrame:
    """Lines of at least two folded characters: conv_id, line_id, seq, speaker, ts, raw, norm."""
    rows = m.select("conv_id", "seq", "ts", "speaker", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
    rows = rows.withColumn("raw", X.stripped("raw")).withColumn("norm", nfkc_fold("raw")).where(F.length("norm") >= 2)
    return rows.withColumn("line_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "pos"))).drop("pos")


def claims_of(items: DataFrame) -> DataFrame:
    """Claims of items (conv_id, section, text): the whole of verbatim sections, quotes of others, none of unquoted ones."""
    whole = F.regexp_replace(X.stripped("text"), "^[「」『』“”\"'‘’]+|[「」『』“”\"'‘’]+$", "")
    found = F.when(F.col("section").isin(*L.VERBATIM_SECTIONS), F.array(X.stripped(whole))).when(F.col("section").isin(*L.UNQUOTED_SECTIONS), F.array().cast("array<string>")).otherwise(X.quotes("text"))
    rows = items.drop("claim").select("*", F.posexplode(found).alias("claim_no", "claim")).withColumn("claim", X.stripped("claim"))
    return rows.withColumn("norm", nfkc_fold("claim")).where(F.length("norm") >= 2)


def _needle_rows(claims: DataFrame, m: DataFrame) -> DataFrame:
    """A row for each form to look for of each claim (conv_id, claim_id, claim)."""
    speakers = m.where("speaker <> ''").select("conv_id", "speaker").distinct().groupBy("conv_id").agg(F.collect_list("speaker").alias("speakers"))
    rows = claims.select("conv_id", "claim_id", "claim").join(speakers, "conv_id", "left")

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from talkframe.functions.udfs import fold

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                known = {fold(s) for s in (r.speakers if r.speakers is not None else [])}
                out += [(r.conv_id, r.claim_id, k, n) for k, n in enumerate(needles(r.claim, known))]
            yield pd.DataFrame(out, columns=["conv_id", "claim_id", "form", "needle"])

    return rows.mapInPandas(forms, "conv_id string, claim_id long, form int, needle string")


#: Forms and lines of a block, and lines that are counted at a time.
FORMS, LINES, AT_ONCE = 512, 16384, 512


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two-character grams of texts as numbers, and the text that each is of."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    inside = of[1:] == of[:-1]
    return ((codes[:-1] << 21) | codes[1:])[inside], of[1:][inside]


def shared_bigrams(forms: list[str], lines: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each AT_ONCE lines the first, and the number of different bigrams that each form has in common with each of them."""
    grams, of = _pairs(forms)
    known, at = np.unique(grams, return_inverse=True)
    mine = np.zeros((len(forms), len(known)), np.float32)
    mine[of, at] = 1
    for first in range(0, len(lines), AT_ONCE):
        some = lines[first : first + AT_ONCE]
        grams, of = _pairs(some)
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        hit = known[at] == grams
        theirs = np.zeros((len(some), len(known)), np.float32)
        theirs[of[hit], at[hit]] = 1
        yield first, mine @ theirs.T


def _bigram_hits(forms: DataFrame, lines: DataFrame, most: int | None) -> DataFrame:
    """conv_id, needle, line_id and hits: lines that share bigrams with a form (conv_id, needle), of each block of lines the first `most` by hits, then number."""
    sizes = lambda df, size, name: df.groupBy("conv_id").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = sizes(forms, FORMS, "fs").join(sizes(lines, LINES, "ls"), "conv_id")
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = forms.join(blocks, "conv_id").select("conv_id", "needle", part("needle", "fs").alias("f"), every("ls").alias("l"))
    right = lines.join(blocks, "conv_id").select("conv_id", "line_id", "norm", part("line_id", "ls").alias("l"), every("fs").alias("f"))

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"conv_id": np.array([], object), "needle": np.array([], object), "line_id": np.array([], np.int64), "hits": np.array([], np.int64)})]
        if len(a) and len(b):
            b = b.sort_values("line_id")
            needles_, ids = a["needle"].to_numpy(object), b["line_id"].to_numpy()
            for first, hits in shared_bigrams(a["needle"].tolist(), b["norm"].tolist()):
                if most is not None and most < hits.shape[1]:
                    # lines come by number: of equal hits the earlier one is first
                    order = np.argsort(-hits, axis=1, kind="stable")[:, :most]
                    x, y = np.repeat(np.arange(len(hits)), most), order.ravel()
                else:
                    x, y = np.divmod(np.arange(hits.size), hits.shape[1])
                n = hits[x, y].astype(np.int64)
                x, y, n = x[n > 0], y[n > 0], n[n > 0]
                out.append(pd.DataFrame({"conv_id": a["conv_id"].iloc[0], "needle": needles_[x], "line_id": ids[first + y], "hits": n}))
                if most is not None:
                    best = pd.concat(out[-2:]).sort_values(["needle", "hits", "line_id"], ascending=[True, False, True])
                    out = [best.groupby("needle", sort=False).head(most)]
        return pd.concat(out)

    return left.groupBy("conv_id", "f", "l").cogroup(right.groupBy("conv_id", "f", "l")).applyInPandas(count, "conv_id string, needle string, line_id long, hits long")


def matched(claims: DataFrame, m: DataFrame, lines: DataFrame | None = None, most: int | None = L.CANDIDATE_LINES) -> DataFrame:
    """Best line of each claim: conv_id, claim_id, score, line_id, by ordered coverage over the lines that share most bigrams.

    Candidates share bigrams, counted between blocks of forms and of lines. `most` candidates a form are compared, which
    is the rule; None compares all lines that share a bigram.
    """
    lines = corpus_lines(m) if lines is None else lines
    wanted = _needle_rows(claims, m).where(F.length("needle") >= 2)
    hits = _bigram_hits(wanted.select("conv_id", "needle").distinct(), lines.select("conv_id", "line_id", "norm"), most)
    w = Window.partitionBy("conv_id", "needle").orderBy(F.desc("hits"), "line_id")
    near = hits.withColumn("place", F.row_number().over(w))
    near = (near if most is None else near.where(F.col("place") <= most)).join(lines.select("conv_id", "line_id", "norm"), ["conv_id", "line_id"])
    near = near.repartition("conv_id", "line_id", "needle").withColumn("score", ordered_coverage("needle", "norm"))
    scored = wanted.select("conv_id", "claim_id", "form", "needle").join(near, ["conv_id", "needle"])
    best = scored.groupBy("conv_id", "claim_id").agg(F.min_by(F.struct("score", "line_id"), F.struct(-F.col("score"), "form", "place")).alias("b"))
    return claims.select("conv_id", "claim_id").join(best, ["conv_id", "claim_id"], "left").select("conv_id", "claim_id", F.round(F.coalesce("b.score", F.lit(0.0)), 3).alias("score"), F.col("b.line_id").alias("line_id"))


#: Characters of a conversation's folded lines that are searched at once.
BLOCK = 65536


def _in_order(piece: str) -> Column:
    """The pieces of a group's lines, one after another."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", piece))), lambda x: x[piece]), "")


def contained(claims: DataFrame, m: DataFrame, lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Claims of which a form stands in a conversation's folded lines, one after another: conv_id, claim_id.

    The lines of up to `block` characters of a conversation are one text, in which its forms are looked for; those of a
    longer one are cut into blocks, and a form is looked for in those that have its rarest key.
    """
    wanted = _needle_rows(claims, m).where(F.length("needle") >= 2).select("conv_id", "claim_id", "needle")
    laid = lines.select("conv_id", "line_id", "norm", F.sum(F.length("norm")).over(Window.partitionBy("conv_id")).alias("total"))
    whole = laid.where(F.col("total") <= block).groupBy("conv_id").agg(_in_order("norm").alias("flat"))
    short = wanted.join(whole, "conv_id").where("contains(flat, needle)").select("conv_id", "claim_id")
    long = laid.where(F.col("total") > block)
    asked = wanted.join(long.select("conv_id").distinct(), "conv_id", "left_semi")
    found = _in_blocks(asked.select("conv_id", "needle").distinct(), long, block)
    return short.unionAll(asked.join(found, ["conv_id", "needle"]).select("conv_id", "claim_id")).distinct()


def _in_blocks(forms: DataFrame, lines: DataFrame, block: int) -> DataFrame:
    """Forms (conv_id, needle) that stand in their conversation's lines: conv_id, needle.

    A block goes on beyond its end for the length of the longest form. Of five keys of a form, 2 to 16 characters at
    even distances, the one that the fewest blocks have names the blocks that are searched.
    """
    n = F.length("needle")
    forms = forms.withColumn("size", F.when(n >= 16, 16).when(n >= 8, 8).otherwise(F.least(n, F.lit(4))))
    of = forms.groupBy("conv_id").agg(F.max(n).alias("reach"), F.collect_set("size").alias("sizes")).withColumn("span", F.greatest("reach", F.lit(block)))
    start = F.coalesce(F.sum(F.length("norm")).over(Window.partitionBy("conv_id").orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = lines.withColumn("start", start).withColumn("end", F.col("start") + F.length("norm")).join(of, "conv_id")
    at = laid.withColumn("block", F.explode(F.expr("sequence(greatest(0L, floor((start - reach) / span)), floor((end - 1) / span))")))
    piece = F.expr("substring(norm, cast(greatest(start, block * span) - start + 1 as int), cast(least(end, (block + 1) * span + reach) - greatest(start, block * span) as int))")
    texts = at.withColumn("piece", piece).groupBy("conv_id", "block").agg(_in_order("piece").alias("flat"), F.first("sizes").alias("sizes"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                for k in r.sizes:
                    keys = np.array(list({r.flat[i : i + k] for i in range(len(r.flat) - k + 1)}), object)
                    yield pd.DataFrame({"conv_id": np.full(len(keys), r.conv_id, object), "block": r.block, "key": keys})

    keys = texts.mapInPandas(cut, "conv_id string, block long, key string")
    probes = forms.select("conv_id", "needle", F.explode(F.expr("array_distinct(transform(sequence(0, 4), i -> substring(needle, cast(1 + (length(needle) - size) * i div 4 as int), size)))")).alias("key"))
    # a key that no block has rules its form out
    rare = probes.join(keys.groupBy("conv_id", "key").agg(F.count("*").alias("blocks")), ["conv_id", "key"], "left")
    rare = rare.groupBy("conv_id", "needle").agg(F.min_by("key", F.struct(F.coalesce("blocks", F.lit(0)), "key")).alias("key"))
    near = rare.join(keys, ["conv_id", "key"]).join(texts.select("conv_id", "block", "flat"), ["conv_id", "block"])
    return near.where("contains(flat, needle)").select("conv_id", "needle").distinct()


def verified(claims: DataFrame, m: DataFrame, threshold: float = L.FUZZY_THRESHOLD) -> DataFrame:
    """conv_id, claim_id, status (skip under two folded characters; verified, fuzzy, unverified), score, nearest."""
    lines = corpus_lines(m)
    exact = contained(claims, m, lines).withColumn("exact", F.lit(True))
    rest = claims.join(exact, ["conv_id", "claim_id"], "left_anti")
    best = matched(rest, m, lines).join(lines.select("conv_id", "line_id", "raw"), ["conv_id", "line_id"], "left")
    status = F.when(F.length(nfkc_fold("claim")) < 2, "skip").when(F.col("exact"), "verified").when(F.col("score") >= threshold, "fuzzy").otherwise("unverified")
    return claims.select("conv_id", "claim_id", "claim").join(exact, ["conv_id", "claim_id"], "left").join(best, ["conv_id", "claim_id"], "left").select(
        "conv_id", "claim_id", "claim", status.alias("status"), F.when(F.col("exact"), 1.0).otherwise(F.col("score")).alias("score"), F.when(F.col("exact"), "").otherwise(F.coalesce("raw", F.lit(""))).alias("nearest"),
    )


def findings_summary(found: DataFrame) -> DataFrame:
    """Claims by status."""
    return found.groupBy("status").agg(F.count("*").alias("n"))


def located(claims: DataFrame, m: DataFrame, threshold: float = L.CITE_THRESHOLD) -> DataFrame:
    """The line that each claim cites, if its coverage suffices."""
    lines = corpus_lines(m)
    return matched(claims, m, lines).where(F.col("score") >= threshold).join(lines.select("conv_id", "line_id", "seq", "speaker", "ts", "raw"), ["conv_id", "line_id"])


def citations(items: DataFrame, m: DataFrame, most: int = 2) -> DataFrame:
    """Per item (conv_id, item_id, section, text) at most two cited lines; lines are numbered by their first use."""
    order = Window.partitionBy("conv_id").orderBy("item_id", "claim_no")
    claims = claims_of(items).where(F.length("claim") >= 3).withColumn("claim_id", F.row_number().over(order).cast("long"))
    found = located(claims.select("conv_id", "claim_id", "claim"), m).join(claims.select("conv_id", "claim_id", "item_id"), ["conv_id", "claim_id"])
    once = found.groupBy("conv_id", "item_id", "line_id", "raw").agg(F.min("claim_id").alias("first"))
    kept = once.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "item_id").orderBy("first"))).where(F.col("place") <= most)
    opened = kept.withColumn("opens", F.min("first").over(Window.partitionBy("conv_id", "line_id")))
    return opened.withColumn("ref", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("opens"))).select("conv_id", "item_id", "ref", "line_id", F.left("raw", F.lit(100)).alias("raw"))


def date_checks(items: DataFrame, m: DataFrame) -> DataFrame:
    """Year-months and month-days of items that no message has, where a conversation has two months and more."""
    timed = m.where("ts IS NOT NULL")
    months = timed.select("conv_id", F.date_format("ts", "yyyy-MM").alias("key")).distinct()
    days = timed.select("conv_id", F.date_format("ts", "M月d日").alias("key")).distinct()
    enough = months.groupBy("conv_id").agg(F.count("*").alias("n")).where("n >= 2").select("conv_id")
    pair = lambda pattern: F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("b"))
    ym = F.transform(pair(L.YEAR_MONTH), lambda x: F.concat(x["a"], F.lit("-"), F.lpad(x["b"].cast("int").cast("string"), 2, "0")))
    md = F.transform(pair(L.MONTH_DAY), lambda x: F.concat(x["a"].cast("int").cast("string"), F.lit("月"), x["b"].cast("int").cast("string"), F.lit("日")))
    base = items.join(enough, "conv_id")
    wrong = base.select("conv_id", "item_id", F.explode(ym).alias("key")).join(months, ["conv_id", "key"], "left_anti")
    return wrong.unionAll(base.select("conv_id", "item_id", F.explode(md).alias("key")).join(days, ["conv_id", "key"], "left_anti")).withColumn("status", F.lit("date_mismatch"))


def month_span(m: DataFrame) -> DataFrame:
    month = F.date_format("ts", "yyyy-MM")
    return m.where("ts IS NOT NULL").groupBy("conv_id").agg(F.concat_ws(" ~ ", F.min(month), F.max(month)).alias("span"))


#: Words, or characters of a claim without inner words, of the keys that claims are looked for by.
KEY_WORDS, KEY_CHARS = (4, 3, 2, 1), (4, 2)
#: Messages of a key from which its rows are dealt out.
HOT_KEY = 4096


def _claim_keys(claims: DataFrame) -> DataFrame:
    """conv_id, claim, kind and gram: every key that a claim could be looked for by.

    Its words but the first and the last stand whole wherever it stands: all their runs of up to four (kind 1 to 4). A
    claim without such words is looked for by its grams of four characters, or of two (kind -4, -2).
    """
    words = F.split("claim", r"\s+")
    rows = claims.select("conv_id", "claim", words.alias("w"), F.least(F.size(words) - 2, F.lit(KEY_WORDS[0])).alias("n"))
    runs = F.transform(F.sequence(F.lit(2), F.size("w") - F.col("n")), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    k = F.when(F.length("claim") >= KEY_CHARS[0], KEY_CHARS[0]).otherwise(KEY_CHARS[1])
    parts = F.expr(f"transform(sequence(1, length(claim) - if(length(claim) >= {KEY_CHARS[0]}, {KEY_CHARS[0]}, {KEY_CHARS[1]}) + 1), i -> substring(claim, i, if(length(claim) >= {KEY_CHARS[0]}, {KEY_CHARS[0]}, {KEY_CHARS[1]})))")
    of_words = rows.where("n >= 1").select("conv_id", "claim", F.col("n").alias("kind"), F.explode(F.array_distinct(runs)).alias("gram"))
    of_chars = rows.where("n < 1").select("conv_id", "claim", (-k).alias("kind"), F.explode(F.array_distinct(parts)).alias("gram"))
    return of_words.unionAll(of_chars)


def _message_keys(m: DataFrame, keys: DataFrame) -> DataFrame:
    """conv_id, seq, kind and each key that a message has, of the kinds that its conversation's claims have; each text is split once."""
    kinds = keys.groupBy("conv_id").agg(F.collect_set("kind").alias("kinds"))
    rows = m.select("conv_id", "seq", "text").join(kinds, "conv_id").select("conv_id", "seq", "text", "kinds", F.split("text", r"\s+").alias("w"))
    runs = lambda n: F.expr(f"if(size(w) >= {n}, transform(sequence(1, size(w) - {n} + 1), i -> array_join(slice(w, i, {n}), ' ')), cast(array() AS array<string>))")
    grams = F.when(F.col("kind") == KEY_WORDS[0], runs(KEY_WORDS[0]))
    for n in KEY_WORDS[1:]:
        grams = grams.when(F.col("kind") == n, runs(n))
    for n in KEY_CHARS:
        grams = grams.when(F.col("kind") == -n, X.ngrams("text", n, n))
    each = rows.select("conv_id", "seq", "text", "w", F.explode("kinds").alias("kind"))
    return each.select("conv_id", "seq", "kind", F.explode(F.array_distinct(grams)).alias("gram"))


def rarest_keys(claims: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, claim, kind, gram, n), and (conv_id, seq, kind, gram) of the messages that have a chosen key.

    Of a claim's keys the one that the fewest messages of its conversation have, n of them; a claim of which a key stands
    nowhere is left out, since it stands nowhere itself.
    """
    keys = _claim_keys(claims.select("conv_id", "claim").distinct())
    asked = keys.select("conv_id", "kind", "gram").distinct()
    held = _message_keys(m, keys).join(asked, ["conv_id", "kind", "gram"], "left_semi")
    counts = held.groupBy("conv_id", "kind", "gram").agg(F.count("*").alias("n"))
    counted = keys.join(counts, ["conv_id", "kind", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    chosen = counted.groupBy("conv_id", "claim").agg(F.min(F.struct("n", "kind", "gram")).alias("k")).select("conv_id", "claim", "k.kind", "k.gram", "k.n").where("n > 0")
    return chosen, held.join(chosen.select("conv_id", "kind", "gram").distinct(), ["conv_id", "kind", "gram"], "left_semi")


def candidates(claims: DataFrame, m: DataFrame, hot: int = HOT_KEY) -> DataFrame:
    """conv_id, claim and seq of the messages that share a claim's rarest key.

    A key of more than `hot` messages is dealt out to parts of about that many, and its claims go to each part.
    """
    chosen, held = rarest_keys(claims, m)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / hot)).cast("int")
    spread = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    of = chosen.groupBy("conv_id", "kind", "gram").agg(F.max(parts).alias("parts"))
    dealt = held.join(of, ["conv_id", "kind", "gram"]).withColumn("part", F.pmod(F.xxhash64("seq"), F.col("parts")).cast("int"))
    return dealt.join(spread, ["conv_id", "kind", "gram", "part"]).select("conv_id", "claim", "seq")


def quoting(items: DataFrame, m: DataFrame) -> DataFrame:
    """Messages that contain a claim (conv_id, item_id, claim of 2 characters and more): those that share its rarest key are tested."""
    wanted = items.where(F.length("claim") >= 2).select("conv_id", "item_id", "claim").distinct()
    near = candidates(wanted, m).join(m, ["conv_id", "seq"]).where(F.expr("contains(text, claim)"))
    return near.join(wanted, ["conv_id", "claim"]).dropDuplicates(["conv_id", "item_id", "seq"])


def token_edge(m: DataFrame, target: DataFrame) -> DataFrame:
    """Tokens that a conversation's target uses in more messages than all others: conv_id, token, mine, theirs."""
    rows = m.join(target, "conv_id").select("conv_id", (F.col("speaker") == F.col("target")).alias("own"), F.explode(X.tokens("text")).alias("token"))
    by = rows.groupBy("conv_id", "token").agg(F.count_if("own").alias("mine"), F.count_if(~F.col("own")).alias("theirs"))
    return by.where((F.col("mine") > F.col("theirs")) & ~F.col("token").isin(*L.UNIQUE_STOP))


def risk(item: Column, quotes: Column, sessions: Column, unique: Column) -> Column:
    return F.when(quotes == 0, "high").when(item.rlike(L.GENERIC_CLAIM) | (sessions <= 1) | (unique == 0), "medium").otherwise("low")


def specificity(items: DataFrame, m: DataFrame, target: DataFrame) -> DataFrame:
    """Per item (conv_id, item_id, text, claim): quotes of the target, sessions, unique tokens, risk and a score of 0 to 100."""
    found = quoting(items.select("conv_id", "item_id", "claim"), m).join(target, "conv_id").where("speaker = target")
    where = with_sessions(m).where("ts IS NOT NULL").select("conv_id", "seq", "session_id")
    counts = found.select("conv_id", "item_id", "seq").join(where, ["conv_id", "seq"], "left").groupBy("conv_id", "item_id").agg(F.count_distinct("seq").alias("quotes"), F.count_distinct("session_id").alias("sessions"))
    own = found.select("conv_id", "item_id", F.explode(X.tokens("text")).alias("token")).distinct().join(token_edge(m, target), ["conv_id", "token"]).groupBy("conv_id", "item_id").agg(F.count("*").alias("unique_words"))
    out = items.select("conv_id", "item_id", "text").distinct().join(counts, ["conv_id", "item_id"], "left").join(own, ["conv_id", "item_id"], "left")
    q, s, u = (F.coalesce(c, F.lit(0)) for c in ("quotes", "sessions", "unique_words"))
    out = out.select("conv_id", "item_id", q.alias("quotes"), s.alias("sessions"), u.alias("unique_words"), risk(F.col("text"), q, s, u).alias("risk"))
    off = F.when(F.col("risk") == "high", 35).when(F.col("risk") == "medium", 12).otherwise(0)
    raw = F.least(F.lit(45), 12 * F.col("quotes")) + F.least(F.lit(30), 15 * F.col("sessions")) + F.least(F.lit(25), 5 * F.col("unique_words")) - off
    return out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), raw)))


def memory_status(kind: Column, text: Column) -> Column:
    """joke, uncertain, promise, plan, fact (something done, not negated in the eight characters before) or mentioned."""
    done = F.regexp_extract_all(text, F.lit(f"([^，。！？；,!?;\\n]{{0,8}})(?:{X.pattern_of(L.DONE_WORDS)})"), F.lit(1))
    return (
        F.when(kind == "joke", "joke").when(X.any_of(text, L.UNCERTAIN_WORDS), "uncertain").when(X.any_of(text, L.PROMISE_WORDS), "promise")
        .when(X.any_of(text, L.PLAN_WORDS), "plan").when(F.exists(done, lambda p: ~p.rlike("[" + "".join(L.NEGATIONS) + "]")), "fact").otherwise("mentioned")
    )


def ledger(items: DataFrame, m: DataFrame) -> DataFrame:
    """Memory items (conv_id, item_id, section, text, claim) with status, dates of their evidence and confidence."""
    found = quoting(items.select("conv_id", "item_id", "claim"), m)
    seen = found.groupBy("conv_id", "item_id").agg(
        F.count("*").alias("evidence"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("time_start"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("time_end"), F.count_distinct(F.to_date("ts")).alias("days"),
    )
    kinds = F.create_map(*(F.lit(x) for kv in L.MEMORY_KINDS.items() for x in kv))
    base = items.groupBy("conv_id", "item_id", "section", "text").agg(F.array_join(F.array_sort(F.collect_list("claim")), " ").alias("said")).withColumn("kind", F.coalesce(kinds[F.col("section")], F.lit("mentioned")))
    out = base.withColumn("status", memory_status(F.col("kind"), F.col("said"))).join(seen, ["conv_id", "item_id"], "left")
    none = F.coalesce("evidence", F.lit(0)) == 0
    out = out.withColumn("status", F.when(none & ~F.col("status").isin("plan", "promise", "joke"), "uncertain").otherwise(F.col("status")))
    return out.select(
        "conv_id", "item_id", F.left(F.sha2(F.concat("section", F.lit("\n"), "text").cast("binary"), 256), F.lit(16)).alias("id"), "section", "kind", "status", "time_start", "time_end",
        F.when(F.col("status").isin("plan", "promise", "uncertain"), "needs_confirmation").otherwise("historical_observation").alias("validity"),
        F.when(none, "uncertain").when(F.col("days") > 1, "repeated_observation").otherwise("single_observation").alias("confidence"), F.coalesce("evidence", F.lit(0)).alias("evidence"),
    )


def retrieved(queries: DataFrame, entries: DataFrame, most: int = 5, budget: int = 1800) -> DataFrame:
    """Entries (conv_id, id, text) for queries (conv_id, query_id, text) by length of shared tokens, within a budget of characters.

    An entry that doesn't fit is skipped for a later one; only entries that could still be chosen are looked at one by one.
    """
    asked = queries.select("conv_id", "query_id", F.explode(X.tokens("text")).alias("token")).where(~F.col("token").isin(*L.RETRIEVAL_STOP)).distinct()
    known = entries.select("conv_id", "id", (F.length("text") + 100).alias("cost"), F.explode(X.tokens("text")).alias("token")).distinct()
    scored = asked.join(known, ["conv_id", "token"]).groupBy("conv_id", "query_id", "id", "cost").agg(F.sum(F.length("token")).alias("score"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, kept = 0, []
        for r in pdf.sort_values(["score", "id"], ascending=[False, True]).itertuples(index=False):
            if used + r.cost <= budget:
                used += r.cost
                kept.append((r.conv_id, r.query_id, r.id, r.score, len(kept) + 1))
                if len(kept) == most:
                    break
        return pd.DataFrame(kept, columns=["conv_id", "query_id", "id", "score", "rank"])

    return scored.where(F.col("cost") <= budget).groupBy("conv_id", "query_id").applyInPandas(run, "conv_id string, query_id long, id string, score long, rank long")


def all_quoted(quotes: DataFrame, m: DataFrame) -> DataFrame:
    """Items (conv_id, item_id, claim) of which every claim stands in some message."""
    present = quoting(quotes.withColumn("item", F.col("item_id")).withColumn("item_id", F.xxhash64("item_id", "claim")), m).select("conv_id", "item_id").distinct()
    marked = quotes.withColumn("key", F.xxhash64("item_id", "claim")).join(present.withColumnsRenamed({"item_id": "key"}).withColumn("present", F.lit(True)), ["conv_id", "key"], "left")
    return marked.groupBy("conv_id", "item_id").agg(F.bool_and(F.coalesce("present", F.lit(False))).alias("all_quoted"))


def counter_evidence(items: DataFrame, m: DataFrame, target: DataFrame, most: int = 5, negation: Sequence[str] = L.NEGATIONS, least: int = 3) -> DataFrame:
    """Target messages with a negation that share a token of `least` characters with an item's evidence and aren't part of it."""
    own = m.join(target, "conv_id").where("speaker = target")
    evidence = quoting(items, m).select("conv_id", "item_id", "seq", "text")
    long = lambda df: df.withColumn("token", F.explode(X.tokens("text"))).where(F.length("token") >= least)
    against = long(own.where(X.any_of("text", negation))).select("conv_id", "seq", "token")
    hits = long(evidence).select("conv_id", "item_id", "token").distinct().join(against, ["conv_id", "token"]).select("conv_id", "item_id", "seq").distinct()
    hits = hits.join(evidence.select("conv_id", "item_id", "seq"), ["conv_id", "item_id", "seq"], "left_anti")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "item_id").orderBy("seq"))).where(F.col("rank") <= most)


def neighbours_of(found: DataFrame, m: DataFrame) -> DataFrame:
    """The message before and after each found one (conv_id, seq)."""
    around = scans.around(m.select("conv_id", "seq", "text"), "text", ["conv_id"], ["seq"], scans.by_number()).drop("text")
    return found.join(around, ["conv_id", "seq"], "left")
