"""Column functions over message texts. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkframe.functions import lexicon as L


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def alternation(words: Iterable[str]) -> str:
    """A pattern of words, longer ones first; equal lengths keep the order of first appearance."""
    return "|".join(re.escape(w) for w in sorted(dict.fromkeys(words), key=len, reverse=True))


def fragments(words: Iterable[str], lo: int = 2, hi: int = 5) -> set[str]:
    """All substrings of lo to hi characters."""
    return {w[i : i + n] for w in words for n in range(lo, hi + 1) for i in range(len(w) - n + 1)}


def noise_fragments() -> set[str]:
    """Pieces of generic words, of stop phrases and of ASCII laughs."""
    return fragments((*L.GENERIC_WORDS, *L.STOP_PHRASES)) | {f for f in fragments(L.LAUGH_WORDS) if f.isascii()}


def any_of(text: Column | str, words: Iterable[str]) -> Column:
    """Whether the text contains any of the words."""
    found = F.lit(False)
    for w in dict.fromkeys(words):
        found = found | col(text).contains(w)
    return found


def occurrences(text: Column | str, word: str) -> Column:
    """Non-overlapping occurrences of a word."""
    t = col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(word), F.lit("")))) / len(word)).cast("long")


def matches(text: Column | str, words: Iterable[str]) -> Column:
    """Non-overlapping matches of the words, longer ones first."""
    return F.regexp_count(col(text), F.lit(alternation(words))).cast("long")


def squeezed(text: Column | str) -> Column:
    """White space collapsed to single blanks, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))


def shortened(text: Column | str, limit: int = 34) -> Column:
    t = squeezed(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(limit)), F.lit("…")))


def stripped(text: Column | str) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def normalized(text: Column | str) -> Column:
    """Media marks of exports reduced to a plain tag."""
    t = F.regexp_replace(col(text), r"\s+local_id=\d+\s*$", "")
    t = F.regexp_replace(t, rf"\[({L.MEDIA_KINDS})\s*[:：][^\[\]]{{0,240}}\]", "[$1]")
    face = r"(?:/[^\s/:：，。！？、]{1,12})+"
    notice = r"^(?:对方|我|你)?已?(?:接收|发送)文件[「『\"].*[」』\"]$"
    return (
        F.when(stripped(t).rlike(notice), "[文件]")
        .when(t.rlike(face) & (stripped(F.regexp_replace(t, face, "")) == ""), "[表情]")
        .otherwise(t)
    )


def is_media_only(text: Column | str, most: int | None = None) -> Column:
    """Nothing but bracket tags (of at most so many characters)."""
    size = "*" if most is None else f"{{0,{most}}}"
    return col(text).rlike(rf"^(?:\s*\[[^\[\]]{size}\]\s*)+$")


def is_question(text: Column | str) -> Column:
    """Ends with a question mark or a question particle."""
    t = F.regexp_replace(col(text), r"\s+$", "")
    found = F.lit(False)
    for e in L.QUESTION_ENDS:
        found = found | t.endswith(e)
    return found


def has_unresolved_reply(text: Column | str) -> Column:
    return col(text).rlike(L.UNRESOLVED_REPLY)


def reply_text(text: Column | str) -> Column:
    return stripped(F.regexp_replace(col(text), L.UNRESOLVED_REPLY, ""))


def emoji(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(L.EMOJI), F.lit(0))


def lines(text: Column | str) -> Column:
    """The text's lines without tags and blanks at the ends; empty lines go."""
    cleaned = F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda x: stripped(F.regexp_replace(x, r"\[[^\[\]]{0,24}\]", " ")))
    return F.filter(cleaned, lambda x: x != "")


def phrases(text: Column | str, stop: Sequence[str] = L.STOP_PHRASES) -> Column:
    """Segments between punctuation: 2 to 8 characters, no brackets, no stop phrases, not all digits."""
    parts = F.transform(F.split(col(text), L.SENTENCE_SPLIT), stripped)
    return F.filter(parts, lambda s: ~s.contains("[") & ~s.contains("]") & F.length(s).between(2, 8) & ~s.isin(*stop) & ~s.rlike(r"^\d+$"))


def is_noise(token: Column | str, fragments: Iterable[str] | None = None) -> Column:
    """Empty, untrimmed, without a letter, with brackets, or a piece of a generic word."""
    t = col(token)
    found = (t == "") | (stripped(t) != t) | t.rlike(r"(?U)^[\W\d_]+$") | t.contains("[") | t.contains("]")
    return found | t.isin(*sorted(noise_fragments() if fragments is None else fragments))


def is_cjk(text: Column | str) -> Column:
    return col(text).rlike(r"^[\x{4e00}-\x{9fff}]*$")


def is_degenerate(text: Column | str) -> Column:
    """At most one distinct character, or two in five characters and more."""
    n = F.size(F.array_distinct(F.split(col(text), "")))
    return (n <= 1) | ((n == 2) & (F.length(col(text)) >= 5))


def is_expressive(token: Column | str) -> Column:
    return ~is_noise(token) & col(token).rlike(L.EXPRESSIVE)


def gram_pieces(text: Column | str, hi: int) -> Column:
    """A text's pieces of 32 beginnings of grams, and what grams of up to hi characters need after them."""
    # substring walks to its place from the start, so pieces are cut from stretches of 1,024 beginnings
    cut = lambda t, size, last: F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: F.substring(t, k * size + 1, F.lit(size - 1 + hi)))
    t = F.coalesce(col(text), F.lit(""))
    return F.flatten(F.transform(cut(t, 1024, F.floor(F.length(t) / 1024)), lambda s: cut(s, 32, F.least(F.lit(31), F.floor(F.length(s) / 32)))))


def piece_grams(piece: Column | str, lo: int, hi: int) -> Column:
    """The character n-grams that begin in the first 32 characters of a piece."""
    p = col(piece)
    of = lambda n: F.when(
        F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.least(F.lit(32), F.length(p) - (n - 1))), lambda i: F.substring(p, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(*(of(n) for n in range(lo, hi + 1)))


def ngrams(text: Column | str, lo: int, hi: int) -> Column:
    """All character n-grams of lo to hi characters, with repeats."""
    return F.flatten(F.transform(gram_pieces(text, hi), lambda p: piece_grams(p, lo, hi)))


def bigrams(text: Column | str) -> Column:
    """The set of two-character grams; a single character stands for itself."""
    t = col(text)
    return F.when(F.length(t) == 1, F.array(t)).otherwise(F.array_distinct(ngrams(t, 2, 2)))


def tokens(text: Column | str) -> Column:
    """Set of 2- to 4-grams of CJK runs and of lower-cased words."""
    runs = F.regexp_extract_all(col(text), F.lit(L.SIGNAL_TOKEN), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(is_cjk(r), ngrams(r, 2, 4)).otherwise(F.array(F.lower(r))))))


def folded(text: Column | str) -> Column:
    """Lower case without white space, punctuation and underscores (no compatibility normalisation; see udfs.nfkc_fold)."""
    return F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"(?U)[\s\W_]+", "")


def iso(ts: Column | str) -> Column:
    """ISO 8601, microseconds only where there are any; null becomes empty."""
    t = col(ts)
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(t, "SSSSSS")
    return F.coalesce(F.when(micros == "000000", base).otherwise(F.concat_ws(".", base, micros)), F.lit(""))


def content_key(ts: Column | str, speaker: Column | str, text: Column | str) -> Column:
    return F.sha2(F.concat_ws("\n", iso(ts), col(speaker), col(text)).cast("binary"), 256)


def message_id(seq: Column | str, ts: Column | str, speaker: Column | str, text: Column | str) -> Column:
    return F.left(F.sha2(F.concat_ws("\n", col(seq).cast("string"), iso(ts), col(speaker), col(text)).cast("binary"), 256), F.lit(16))


def redacted(text: Column | str, rules: Sequence[tuple[str, str]] = L.REDACTIONS) -> Column:
    """Personal data replaced by tags, one rule after another; \\b and \\w follow Unicode."""
    t = col(text)
    for pattern, tag in rules:
        t = F.regexp_replace(t, f"(?U){pattern}" if r"\b" in pattern or r"\w" in pattern else pattern, tag)
    return t


def deixis_flagged(text: Column | str) -> Column:
    t = col(text)
    return F.when(t.rlike("|".join(map(re.escape, L.DEIXIS))), F.concat(t, F.lit(" " + L.DEIXIS_MARK))).otherwise(t)


def quotes(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(L.QUOTE), F.lit(1))


def pattern_of(words: Iterable[str]) -> str:
    return "|".join(map(re.escape, dict.fromkeys(words)))


def minutes_text(minutes: Column | str, zero: str = "—") -> Column:
    """A duration for people."""
    m = col(minutes)
    return (
        F.when(m <= 0, zero).when(m < 1, "不到 1 分钟").when(m < 60, F.concat(F.format_string("%.0f", m), F.lit(" 分钟")))
        .when(m < 1440, F.concat(F.format_string("%.1f", m / 60), F.lit(" 小时"))).otherwise(F.concat(F.format_string("%.1f", m / 1440), F.lit(" 天")))
    )


def half_even(value: Column | str, digits: int = 1) -> Column:
    """Rounding half to even on the decimal form."""
    return F.bround(col(value), digits)
