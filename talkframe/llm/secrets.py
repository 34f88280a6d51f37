r"""Secret scans with a battery of randomness tests, in DataFrame operations only.

Base kinds are patterns: `assign` (a credential's name, a sign, a value of at least 12 characters), `access`
(AKIA and capitals or digits, at least 18 characters), `hex` (at least 16 lower-case hexadecimal digits).

The method adds `random` spans. Candidates are maximal runs of `[A-Za-z0-9+/_-]` of at least 20 characters.
Each has an inferred encoding (the smallest of ALPHABETS that holds it) and is tested against uniform draws from
that alphabet: chi-squared over the alphabet (Wilson-Hilferty), runs above and below the alphabet's middle, and
serial correlation of neighbours; three times the smallest of the three p-values is the candidate's p-value. Within
each stratum of lengths (powers of two) Benjamini-Hochberg finds those that aren't uniform draws, at `uneven_rate`:
a long identifier fails on a small departure, a short secret isn't lost to one test of many. Of what is left, text
that looks uniform is sorted out by the likelihood ratio of uniform draws from the inferred alphabet to text: classes
follow each other by TEXT_NEXT, letters by the pairs counted in the table outside of candidates. Under text a ratio of
r or more has a chance of 1 / r at most (Markov), after a share for each encoding that could have been inferred; these
p-values are held to `rate` by Benjamini-Hochberg within the same strata. Both come from counts in bins (a few thousand
rows whatever the input). A candidate that passes both and overlaps no base span is a `random` span.

Spans are kind:start:end in code points, end exclusive, by start and then by kind as listed (assign, access,
hex, random), comma-joined. Defined results: a null text counts as empty and has no spans; rows that repeat an
id are scanned each; a null id stays null; a text of any length and with any number of matches is read whole; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters in all
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base52": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
ENCODED = {"hex": "^([0-9a-f]+|[0-9A-F]+)$", "letters": "^([a-z]+|[A-Z]+)$", "base32": "^[A-Z2-7]+$", "base36": "^([a-z0-9]+|[A-Z0-9]+)$", "base52": "^[A-Za-z]+$"}
#: Encodings that come in capitals and in small letters count twice.
ONE_CASE = ("hex", "letters", "base36")
#: Chances in ordinary text (identifiers, dates and paths included) of a capital, small letter, digit or sign after one of them.
TEXT_NEXT = {"U": (0.60, 0.32, 0.04, 0.04), "l": (0.04, 0.84, 0.04, 0.08), "d": (0.05, 0.05, 0.75, 0.15), "s": (0.15, 0.45, 0.25, 0.15)}
#: Letters from a to z in a thousandth of a percent, the share of a letter that they give whatever stands before it.
TEXT_LETTERS = (8200, 1500, 2800, 4300, 12700, 2200, 2000, 6100, 7000, 150, 770, 4000, 2400, 6700, 7500, 1900, 95, 6000, 6300, 9100, 2800, 980, 2400, 150, 2000, 74)
ANY_LETTER, PRIOR = 0.3, 26
BINS_PER_UNIT, MOST_BINS = 10, 400


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: int, pattern: str, value_at_least: int = 0) -> Column:
    """array<struct<start, kind, end>> of a pattern's matches in `text`; places come from the pieces between matches.

    Lengths are summed in runs of about the root of their number, so many matches don't make it slow.
    """
    values = f"regexp_extract_all(text, {_quoted(pattern)}, 2)" if value_at_least else "array('')"
    sizes = f"""transform(array(struct(split(text, {_quoted(pattern)}, -1) AS pieces, regexp_extract_all(text, {_quoted(pattern)}, 0) AS found, {values} AS vals)), p -> struct(
        transform(p.found, (f, i) -> struct(length(get(p.pieces, i)) AS gap, length(f) AS size, {"length(get(p.vals, i))" if value_at_least else "0"} AS val)) AS m,
        greatest(16, int(ceil(sqrt(size(p.found))))) AS per))"""
    runs = f"transform({sizes}, p -> transform(sequence(0, (size(p.m) - 1) div p.per), c -> slice(p.m, int(c * p.per + 1), p.per)))[0]"
    walked = """aggregate(run, struct(from AS at, cast(array() AS array<struct<start: int, end: int, val: int>>) AS done),
        (a, x) -> struct(a.at + x.gap + x.size AS at, concat(a.done, array(struct(a.at + x.gap AS start, a.at + x.gap + x.size AS end, x.val AS val))) AS done)).done"""
    starts = "aggregate(runs, struct(0 AS at, cast(array() AS array<int>) AS done), (a, r) -> struct(aggregate(r, a.at, (n, x) -> n + x.gap + x.size) AS at, concat(a.done, array(a.at)) AS done)).done"
    all_ = f"transform(array({runs}), runs -> flatten(zip_with(runs, {starts}, (run, from) -> {walked})))[0]"
    spans = f"transform(filter({all_}, s -> s.val >= {value_at_least}), s -> struct(s.start AS start, {kind} AS kind, s.end AS end))"
    return F.expr(f"if(text rlike {_quoted(pattern)}, {spans}, cast(array() AS array<struct<start: int, kind: int, end: int>>))")


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(array_sort({spans}), s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def _normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) by Abramowitz and Stegun 7.1.26, within 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _step(df: DataFrame, column: str, make: Callable[[Column], dict[str, Column]], keep: tuple[str, ...]) -> DataFrame:
    """Each struct of an array column with more fields, and of its old ones only `keep`."""
    fields = lambda s: F.struct(*(s[k].alias(k) for k in keep), *(v.alias(k) for k, v in make(s).items()))
    return df.withColumn(column, F.transform(column, fields))


def text_pairs(texts: DataFrame) -> dict[str, int]:
    """Counts of neighbouring letters in `text` outside of candidates, at most 26 * 26."""
    words = texts.select(F.explode(F.split(F.lower(F.regexp_replace("text", CANDIDATE, " ")), "[^a-z]+")).alias("w")).where("length(w) > 1")
    pairs = words.select(F.expr("explode(transform(sequence(1, length(w) - 1), i -> substring(w, i, 2)))").alias("pair"))
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()}


def _text_costs(pairs: Mapping[str, int]) -> Column:
    """-log10 of the chance that text has a character of base 64 after another, at 64 * (place before) + place."""
    letters, all_ = ALPHABETS["letters"], sum(TEXT_LETTERS)
    share = {c: n / all_ for c, n in zip(letters, TEXT_LETTERS, strict=True)}
    seen = {a: sum(pairs.get(a + b, 0) for b in letters) for a in letters}
    kind = lambda c: "U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "s"

    def within(a: str, b: str) -> float:
        if not b.isalpha():
            return 1 / 10 if b.isdigit() else 1 / 2
        a, b = a.lower(), b.lower()
        if a not in seen:
            return share[b]
        return ANY_LETTER * share[b] + (1 - ANY_LETTER) * (pairs.get(a + b, 0) + PRIOR * share[b]) / (seen[a] + PRIOR)

    costs = (-math.log10(TEXT_NEXT[kind(a)]["Ulds".index(kind(b))] * within(a, b)) for a in ALPHABETS["base64"] for b in ALPHABETS["base64"])
    return F.split(F.lit(",".join(f"{c:.4f}" for c in costs)), ",").cast("array<double>")


def battery(df: DataFrame, column: str = "candidates", keep: tuple[str, ...] = ("start", "end", "token"), pairs: Mapping[str, int] | None = None) -> DataFrame:
    """Adds encoding, p_uniform (combined), score (-log10 p against ordinary text with these pairs of letters), stratum, and the bins of both (`uneven` and `bin`) to the structs of an array column, which have a `token`."""
    costs = _text_costs(pairs or {})
    choices = len(ALPHABETS) + len(ONE_CASE)

    def alphabet(s):
        t = s["token"]
        return {"encoding": F.coalesce(*(F.when(t.rlike(pattern), name) for name, pattern in ENCODED.items()), F.lit("base64"))}

    def plain(s):
        letters = F.coalesce(*(F.when(s["encoding"] == name, F.lit(ALPHABETS[name])) for name in ENCODED), F.lit(ALPHABETS["base64"]))
        signs = F.translate(s["token"], "-_", "+/")
        text = F.when(s["encoding"].isin(*ONE_CASE), F.lower(s["token"])).otherwise(signs)
        return {"alphabet": letters, "plain": text, "signs": signs, "n": F.length(s["token"]).cast("double")}

    def split(s):
        return {
            "k": F.length(s["alphabet"]).cast("double"),
            "places": F.transform(F.split(s["plain"], ""), lambda c: F.instr(s["alphabet"], c).cast("double")),
            "squares": F.aggregate(F.split(s["alphabet"], ""), F.lit(0.0), lambda a, c: a + F.pow((F.length(s["plain"]) - F.length(F.replace(s["plain"], c, F.lit("")))).cast("double"), F.lit(2.0))),
            "of64": F.transform(F.split(s["signs"], ""), lambda c: F.instr(F.lit(ALPHABETS["base64"]), c) - 1),
        }

    def neighbours(array, differ):
        return F.size(F.filter(F.sequence(F.lit(1), F.size(array) - 1), lambda i: differ(F.get(array, i), F.get(array, i - 1)))).cast("double")

    def sums(s):
        half = s["k"] / 2
        return {
            "chi": s["k"] / s["n"] * s["squares"] - s["n"],
            "above": F.size(F.filter(s["places"], lambda x: x > half)).cast("double"),
            "runs": 1 + neighbours(s["places"], lambda x, y: (x > half) != (y > half)),
            "mean": F.aggregate(s["places"], F.lit(0.0), lambda a, x: a + x) / s["n"],
            "cost": F.aggregate(F.sequence(F.lit(1), F.size(s["of64"]) - 1), F.lit(0.0), lambda a, i: a + F.get(costs, 64 * F.get(s["of64"], i - 1) + F.get(s["of64"], i))),
        }

    def spread(s):
        p, m = s["places"], s["mean"]
        return {
            "var": F.aggregate(p, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)),
            "cov": F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda a, i: a + (F.get(p, i) - m) * (F.get(p, i - 1) - m)),
        }

    def tested(s):
        n, a, df_ = s["n"], s["above"], s["k"] - 1
        z_chi = (F.pow(F.greatest(s["chi"], F.lit(0.0)) / df_, F.lit(1 / 3)) - (1 - 2 / (9 * df_))) / F.sqrt(2 / (9 * df_))
        expected = 1 + 2 * a * (n - a) / n
        variance = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9))
        z_runs = F.when((a > 0) & (a < n), (s["runs"] - expected) / F.sqrt(variance)).otherwise(F.lit(9.0))
        z_serial = F.when(s["var"] > 0, (s["cov"] / s["var"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        least = F.least(_normal_tail(z_chi), _normal_tail(z_runs), _normal_tail(z_serial))
        against = s["cost"] - (n - 1) * F.log10(s["k"]) - math.log10(choices)
        return {"p_uniform": F.least(3 * least, F.lit(1.0)), "score": F.greatest(against, F.lit(0.0))}

    def binned(units):
        return F.least((units * BINS_PER_UNIT).cast("int"), F.lit(MOST_BINS))

    def placed(s):
        return {"stratum": F.least(F.log2(F.length(s["token"]).cast("double")).cast("int"), F.lit(16)), "bin": binned(s["score"]), "uneven": binned(-F.log10(F.greatest(s["p_uniform"], F.lit(1e-300))))}

    df = _step(df, column, alphabet, keep)
    df = _step(df, column, plain, (*keep, "encoding"))
    df = _step(df, column, split, (*keep, "encoding", "alphabet", "plain", "signs", "n"))
    df = _step(df, column, sums, (*keep, "encoding", "n", "k", "places"))
    df = _step(df, column, spread, (*keep, "encoding", "n", "k", "chi", "above", "runs", "cost", "places", "mean"))
    df = _step(df, column, tested, (*keep, "encoding", "n", "k", "chi", "above", "runs", "cost", "var", "cov"))
    return _step(df, column, placed, (*keep, "encoding", "p_uniform", "score"))


def thresholds(tested: DataFrame, column: str, rate: float) -> DataFrame:
    """(stratum, least_bin): the bin of a column, -log10 of p, from which a stratum's candidates are discoveries at a false-discovery rate (Benjamini-Hochberg)."""
    bins = tested.groupBy("stratum", F.col(column).alias("bin")).agg(F.count("*").alias("n"))
    steps = bins.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("b"))  # at most 401 bins
    all_ = "aggregate(b, 0L, (a, x) -> a + x.n)"
    least = F.expr(f"array_min(transform(filter(b, x -> {all_} * pow(10D, -x.bin / {BINS_PER_UNIT}D) <= {rate}D * aggregate(filter(b, y -> y.bin >= x.bin), 0L, (a, y) -> a + y.n)), x -> x.bin))")
    return steps.select("stratum", least.alias("least_bin")).where("least_bin is not null")


def _candidates(texts: DataFrame, based: bool) -> DataFrame:
    """texts with `candidates`, and with `base` if asked for."""
    out = texts.withColumn("candidates", _spans(3, CANDIDATE))
    if based:
        out = out.withColumns({"assign": _spans(0, ASSIGN, 12), "access": _spans(1, ACCESS), "hex": _spans(2, HEX)})
    return out.withColumn("candidates", F.expr("""transform(candidates, s -> struct(s.start AS start, s.end AS end, substring(text, s.start + 1, s.end - s.start) AS token))"""))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uneven_rate: float = 0.01, rate: float = 0.01) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_spans and spans.

    uneven_rate: false-discovery rate at which candidates are found not to be uniform draws; rate: that at which they
    are found not to be text. Two passes over the texts, on the map side: the pairs of letters, then everything else,
    written without the texts; thresholds (17 strata of each kind at most) come from what is written.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = text_pairs(texts)
    found = battery(_candidates(texts, True).drop("text"), keep=("start", "end", "token"), pairs=pairs)
    found = written(found.withColumn("candidates", F.transform("candidates", lambda s: s.dropFields("token"))))
    tested = found.select(F.inline("candidates"))
    limit = lambda column, r, only=None: {x["stratum"]: x["least_bin"] for x in thresholds(tested if only is None else tested.where(only), column, r).collect()}
    at = lambda s, by: F.coalesce(*(F.when(s["stratum"] == k, F.lit(v)) for k, v in by.items()), F.lit(MOST_BINS + 1))
    odd = limit("uneven", uneven_rate)
    even = F.coalesce(*(F.when(F.col("stratum") == k, F.col("uneven") < v) for k, v in odd.items()), F.lit(True))
    strange = limit("bin", rate, even)
    base = F.concat("assign", "access", "hex")
    passed = F.filter("candidates", lambda s: (s["uneven"] < at(s, odd)) & (s["bin"] >= at(s, strange)))
    found = found.withColumns({"base": base, "passed": passed})
    free = F.expr("transform(filter(passed, s -> NOT exists(base, b -> b.start < s.end AND s.start < b.end)), s -> struct(s.start AS start, 3 AS kind, s.end AS end))")
    found = found.withColumn("random", free)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.expr(_joined("base")).alias("base_spans"), F.expr(_joined("concat(base, random)")).alias("spans"))
