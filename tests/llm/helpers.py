"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and very long texts, ties, repeated rows.
AWKWARD = [
    (1, "", "en", "a", 0), (2, None, "en", None, None), (None, "no id here at all", None, "a", 3), (3, "x " * 40_000, "en", "b", 80_000),
    (4, "same text twice, one two three four five six seven eight nine ten eleven twelve", "en", "a", 1), (5, "same text  twice, one two three four five six seven eight nine ten eleven twelve", "de", "b", 1),
    (6, " \t\n", None, "c", 3), (7, "12345 67890 !!! ???", None, "c", 3), (7, "12345 67890 !!! ???", None, "c", 3), (8, "héllo wörld 漢字 😀 " * 30, "fr", "c", 3),
]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "doc_id AS id", "'x' AS size", "1 AS taken", "'y' AS kept", "0 AS score", "'z' AS token", "2 AS component", "3 AS owner", "4 AS removed", "5 AS fingerprint", "'w' AS line", "6 AS lines") if extra else df


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORDS(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows):
    """{doc_id: (n_shingles, component)} by comparing documents that share a shingle."""
    sets = {d: shingles(t) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for d in sorted(sets):
        met = defaultdict(int)
        for s in sets[d]:
            for o in inverted[s]:
                met[o] += 1
            inverted[s].append(d)
        for o, n in met.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def windows_removed(rows, span=13):
    """{doc_id: (n_words, n_removed, sha256 of what is kept)}."""
    first = {}
    for d, t in rows:
        w = WORDS(t or "")
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in rows:
        w = WORDS(t or "")
        gone = {i + j for i in range(len(w) - span + 1) if first[tuple(w[i : i + span])] < d for j in range(span)}
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out
