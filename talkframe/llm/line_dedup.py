r"""Line dedup by winnowing over line hashes.

A document is the sequence of its non-blank lines, stripped of white space at both ends. A run of at least
`run_lines` lines goes from wherever it doesn't stand first (smallest doc_id, then position); a line of at least
`long_words` words is a run by itself (`long_words=1` makes every line one).

1. Fingerprints. Of every window of `run_lines` consecutive lines the smallest line hash is selected, the last one of
   equal ones; windows that overlap mostly select the same line, which is posted once (about 2 lines of
   run_lines + 1). Whatever run of run_lines lines two places share, they share its fingerprint.
2. Positions. Fingerprints of one place only are dropped. The others are joined with the earliest place of each.
3. Matches. A place and the earliest one are compared line by line, by 128 bits of each line, from the fingerprint
   both ways as far as windows reach that can hold it; a match of at least run_lines lines is deleted. Matches that
   adjoin are one longer run, so runs grow as far as they are equal.
4. The rest. A window around a fingerprint that differs from the earliest place may equal another one: those few
   windows are joined among themselves by 128 bits of hash, again with the earliest place.

The result is exactly that of comparing all windows. Blank lines and the earliest place of each run stay.

Defined results: a null text stays null and an empty one empty; rows without an id are kept as they are; rows that
repeat an id are one document and don't delete each other; a run that repeats within a document loses its later
places; a text of which nothing is left becomes empty; a text of any length is read whole; an empty table gives an
empty result; columns other than id, text (and n_chars, which is counted anew where it exists) pass unchanged,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.bitmaps import pruned
from talkframe.llm.common import SPACE_CLASS, WORD_CLASS, written


def _lines(docs: DataFrame, id_col: str, text_col: str, long_words: int) -> DataFrame:
    """doc_id, and of its non-blank lines: number, two hashes, and the places of long ones."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stripped = F.filter(
        F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), F.regexp_replace(x, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "").alias("text"))),
        lambda x: x["text"] != "",
    )
    # a line's words are counted only where it is long enough to have so many
    is_long = lambda x: (F.length(x["text"]) >= 2 * long_words - 1) & (F.regexp_count(x["text"], F.lit(f"{WORD_CLASS}+")) >= long_words)
    hashed = lambda x: F.struct(x["line"], F.xxhash64(x["text"]).alias("h"), F.xxhash64(F.lit("line"), x["text"]).alias("g"), is_long(x).alias("long"))
    lines = texts.select("doc_id", F.transform(stripped, hashed).alias("lines")).where(F.size("lines") > 0)
    return lines.select("doc_id", *(F.col(f"lines.{c}").alias(c) for c in ("line", "h", "g", "long")))


def _places(lines: DataFrame, run_lines: int) -> DataFrame:
    """doc_id, fingerprint, at, run (lines of its windows), and around: the lines from at - run + 1 to at + run - 1, null outside the text."""
    t = run_lines
    windows = f"transform(if(size(h) >= {t}, sequence(0, size(h) - {t}), cast(array() AS array<int>)), i -> reverse(slice(h, i + 1, {t})))"
    selected = F.expr(f"array_distinct(transform({windows}, (w, i) -> int(i + {t} - array_position(w, array_min(w)))))")
    alone = F.expr("filter(transform(long, (x, i) -> if(x, i, null)), i -> i IS NOT NULL)")
    around_of = "transform(sequence(p.at - p.run + 1, p.at + p.run - 1), k -> struct(get(h, k) AS h, get(g, k) AS g, get(line, k) AS line))"
    # a line that is a run by itself is told apart by its last bit
    fingerprint_of = "get(h, p.at) ^ if(p.run = 1, 1L, 0L)"
    posted = F.concat(F.transform(selected, lambda p: F.struct(p.alias("at"), F.lit(t).alias("run"))), F.transform(alone, lambda p: F.struct(p.alias("at"), F.lit(1).alias("run"))))
    # places take their lines along before they become rows, so that no row carries its whole text's hashes
    narrow = F.expr(f"transform(posted, p -> struct({fingerprint_of} AS fingerprint, p.at AS at, p.run AS run, {around_of} AS around))")
    each = lines.select("doc_id", "line", "h", "g", posted.alias("posted")).select("doc_id", F.explode(narrow).alias("p"))
    return each.select("doc_id", "p.*")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_lines: int = 2, long_words: int = 50) -> DataFrame:
    """doc_id and `removed`, the ascending line numbers (from 0, blank lines counted) of its later repeated runs."""
    if run_lines < 1:
        raise ValueError("a run has at least one line")
    places = _places(written(_lines(docs, id_col, text_col, long_words)), run_lines)
    place = F.struct("doc_id", "at")
    shared = places.groupBy("fingerprint").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("fingerprint")
    near = written(pruned(places, "fingerprint", shared, bits=1 << 24))
    # a table of its own, so that the join can split a fingerprint of many places
    earliest = written(near.groupBy("fingerprint").agg(F.min_by("around", place).alias("other"), F.min(place).alias("first")))
    # the fingerprint stands in the middle; left and right are the lines that match from it on, itself counted in both
    met = near.join(earliest, "fingerprint").withColumn("same", F.expr("zip_with(around, other, (x, y) -> coalesce(x.h = y.h AND x.g = y.g, false))"))
    met = met.withColumns({
        "left": F.expr("aggregate(sequence(1, run), 0, (n, k) -> if(n = k - 1 AND get(same, run - k), k, n))"),
        "right": F.expr("aggregate(sequence(1, run), 0, (n, k) -> if(n = k - 1 AND get(same, run + k - 2), k, n))"),
    })
    later = F.when((place > F.col("first")) & (F.col("left") + F.col("right") - 1 >= F.col("run")), F.expr("transform(slice(around, run - left + 1, left + right - 1), x -> x.line)"))
    # windows inside the text that the fingerprint was selected of and that aren't in the match
    others = F.expr("""transform(filter(sequence(0, run - 1), k ->
        NOT (k >= run - left AND k < right) AND forall(slice(around, k + 1, run), x -> x.h IS NOT NULL)
        AND NOT exists(transform(slice(around, k + 1, run), (x, j) -> x.h < get(around, run - 1).h OR (x.h = get(around, run - 1).h AND j > run - 1 - k)), x -> x)),
        k -> struct(at - run + 1 + k AS at, slice(around, k + 1, run) AS w))""")
    met = written(met.select("doc_id", "run", later.alias("covered"), others.alias("others")).where("covered IS NOT NULL OR size(others) > 0"))
    rest = met.select("doc_id", "run", F.explode("others").alias("x")).select(
        "doc_id", "run", "x.at", F.xxhash64("x.w.h").alias("a"), F.xxhash64("x.w.g").alias("b"), F.col("x.w.line").alias("covered")
    )
    again = written(rest.groupBy("a", "b", "run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("a", "b", "run", "first"))
    rest = rest.join(again, ["a", "b", "run"]).where(place > F.col("first")).select("doc_id", "covered")
    covered = met.where("covered IS NOT NULL").select("doc_id", "covered").unionAll(rest)
    # lines before documents: what a document loses is combined before it is shuffled
    return covered.select("doc_id", F.explode("covered").alias("line")).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("line")).alias("removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_lines: int = 2, long_words: int = 50) -> DataFrame:
    """docs with the later repeated runs of lines taken out of their texts."""
    gone = written(repeated_lines(docs, id_col, text_col, run_lines, long_words).select(F.col("doc_id").alias("__id"), "removed"))
    with_id = docs.withColumn("__id", F.col(id_col).cast("long"))
    rest = pruned(with_id, "__id", gone, outside=True).select(docs.columns)
    # both sides in linear time: the numbers that stay by a hash set, their lines by position
    text = F.expr(f"array_join(transform(array(split(`{text_col}`, '\\n', -1)), x -> transform(array_except(sequence(0, size(x) - 1), __removed), i -> x[i]))[0], '\\n')")
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(text)
    columns = {text_col: text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    met = pruned(with_id, "__id", gone).join(gone.select(F.col("__id").alias("__of"), F.col("removed").alias("__removed")), F.col("__id") == F.col("__of"), "left")
    return met.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns)).unionByName(rest)
