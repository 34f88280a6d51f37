"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has two models. One is a character model of order `ORDER` within lower-cased words; its
highest order holds the class's own counts, and everything below is one chain of continuation counts that both
classes share. The other counts whole words by documents and backs off to the number of classes that have a word. So a rare
expression backs off to the same probability in both and says little. A text's score compares the length-normalised
log-likelihoods of each, over the whole text and over its most telling words, and a logistic calibration turns
that into the probability of label 1; it sees each labelled row as a model judges it that was counted without the
row's fold. Models are built in tasks, one for each fold and one of all rows.

Fitting reads at most `per_class` labelled rows of each class, whole texts, chosen by a seeded hash of the id;
that bound is the parameter. Every text is scored whole, however long it is.

Defined results: a null or empty text has neutral features and is scored from them; labels other than 0 and 1
and null labels are ignored, an id with both labels counts as toxic; without labelled rows of both classes the
score is the share of toxic ones (0 without any); rows that repeat an id are scored each; an empty table gives
an empty result; other columns pass unchanged, whatever their names (but for that of the score).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import fold, give_back, lean, written
from talkframe.llm.words import hashed, mixed

ORDER, DISCOUNT = 6, 0.75
_WORDS = re.compile(r"[^\W\d_]+").findall
_BASE = 0x9E3779B97F4A7C15
#: Ratios of both models over the whole text and over its 1, 3 and 10 most telling words; the calibration adds an intercept.
FEATURES = 8
#: Words whose grams are counted at once.
CHUNK = 20_000


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each with ORDER - 1 signs of its start and one of its end, and their numbers."""
    padded = ["\x02" * (ORDER - 1) + w + "\x03" for w in words]
    return np.frombuffer("".join(padded).encode("utf-32-le"), "<u4").astype(np.uint64), np.array([len(p) for p in padded], np.int64)


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive code points."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        out = (out + codes[k : len(out) + k]) * np.uint64(_BASE)
    return mixed(out)


def _of_rows(characters: np.ndarray) -> np.ndarray:
    """Hash of each row of code points, the same as that of the characters in a text."""
    out = np.zeros(len(characters), np.uint64)
    for k in range(characters.shape[1]):
        out = (out + characters[:, k]) * np.uint64(_BASE)
    return mixed(out)


def kneser_ney(words: list[str], ordinary: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values: log P(toxic) - log P(ordinary) of the last character of each gram of ORDER, and of its contexts.

    words with their numbers in both classes. The highest order has each class's own counts; the orders below are one
    chain of continuation counts (how many different grams end so) over both classes. Where neither class has a gram,
    the shared probability cancels and only the weights with which the classes back off from its context remain.
    """
    found = []
    for at in range(0, len(words), CHUNK):
        codes, size = _codes(words[at : at + CHUNK])
        grams = size - ORDER + 1
        # places of grams: the first characters of all but the last ORDER - 1 in a word
        place = np.arange(int(grams.sum())) + np.repeat(np.cumsum(size) - size - np.cumsum(grams) + grams, grams)
        each = at + np.repeat(np.arange(len(size)), grams)
        key, first, of = np.unique(_hashes(codes, ORDER)[place], return_index=True, return_inverse=True)
        characters = codes[place[first][:, None] + np.arange(ORDER)].astype(np.uint32)
        found.append((key, characters, *(np.bincount(of, weights=n[each], minlength=len(key)) for n in (ordinary, toxic))))
    key, characters, *counts = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    gram, first, of = np.unique(key, return_index=True, return_inverse=True)
    characters, counts = characters[first], [np.bincount(of, weights=n, minlength=len(gram)) for n in counts]

    # shared orders from the highest down: each with the numbers of different grams one character longer that end so
    levels, above = [], characters
    for _ in range(ORDER - 1):
        _, i, inverse, n = np.unique(_of_rows(above[:, 1:]), return_index=True, return_inverse=True, return_counts=True)
        above = above[i, 1:]
        levels.append((above, inverse, n))
    # and from the lowest up: probabilities interpolated with the order below
    below = np.full(1, 1.0 / (len(above) + 1))
    suffix = np.zeros(len(above), np.int64)
    for here, inverse, n in reversed(levels):
        h = np.unique(_of_rows(here[:, :-1]), return_inverse=True)[1] if here.shape[1] > 1 else np.zeros(len(here), np.int64)
        total, kinds = np.bincount(h, weights=n), np.bincount(h)
        below = np.maximum(n - DISCOUNT, 0) / total[h] + DISCOUNT * kinds[h] / total[h] * below[suffix]
        suffix = inverse
    context, h = np.unique(_of_rows(characters[:, :-1]), return_inverse=True)
    logs, backs = [], []
    for n in counts:
        total, kinds = np.bincount(h, weights=n), np.bincount(h, weights=n > 0)
        seen = total > 0
        back = np.where(seen, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.where(seen[h], np.maximum(n - DISCOUNT, 0) / np.maximum(total[h], 1), 0.0)
        logs.append(np.log(own + back[h] * below[suffix]))
        backs.append(np.log(back))
    keys, values = np.concatenate([gram, context]), np.concatenate([logs[1] - logs[0], backs[1] - backs[0]]).astype(np.float32)
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def discounts(n: np.ndarray) -> np.ndarray:
    """What Kneser-Ney takes off each count: three discounts, estimated from how many words are counted 1 to 4 times."""
    of = [max(1, int((n == k).sum())) for k in range(1, 5)]
    y = of[0] / (of[0] + 2 * of[1])
    by = np.array([0.0, *(min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.1 * k), 0.95 * k) for k in (1, 2, 3))])
    return by[np.minimum(n, 3)]


def whole_words(words: list[str], ordinary: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values: log P(toxic) - log P(ordinary) of whole words, from the numbers of documents that have them.

    Each class's discounted counts back off to continuation counts: in how many classes a word stands.
    """
    kinds = (ordinary > 0).astype(np.int64) + (toxic > 0)
    both, logs = kinds / max(1, int(kinds.sum())), []
    for n in (ordinary, toxic):
        off, total = discounts(n), max(1, int(n.sum()))
        # a class without words says nothing of any
        share = (n - off) / total + off.sum() / total * both if off.sum() > 0 else np.full(len(n), 1.0 / max(1, len(n)))
        logs.append(np.log(np.maximum(share, 1e-300)))
    keys = hashed(np.frombuffer(" ".join(words).encode("utf-8"), np.uint8))[2]
    order = np.argsort(keys, kind="stable")
    return keys[order], (logs[1] - logs[0]).astype(np.float32)[order]


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which asked keys there are, and their values (0 for others)."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[at] == asked
    return hit, np.where(hit, values[at], np.float32(0))


@dataclass
class Scorer:
    """Tables of both models, the calibration, and the scores of words met so far."""

    grams: tuple[np.ndarray, np.ndarray]
    wholes: tuple[np.ndarray, np.ndarray]
    prior: float
    weights: np.ndarray | None = None

    def __post_init__(self):
        self.known: dict[str, int] = {}
        self.ratios = np.zeros((2, 0))

    @classmethod
    def of(cls, row, prior: float) -> Scorer:
        """From the tables that `_model` makes."""
        pair = lambda k: (np.frombuffer(row[f"{k}keys"], np.uint64), np.frombuffer(row[f"{k}values"], np.float32))
        return cls(pair(""), pair("word_"), prior)

    @classmethod
    def constant(cls, prior: float) -> Scorer:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
        return cls(none, none, prior)

    def learn(self, words: list[str]) -> None:
        """Log-likelihood ratios of words by characters and as wholes, in one go."""
        codes, size = _codes(words)
        first = np.cumsum(size) - size
        hit, value = _looked_up(*self.grams, _hashes(codes, ORDER))
        miss = np.flatnonzero(~hit)
        value[miss] = _looked_up(*self.grams, _hashes(codes, ORDER - 1)[miss])[1]
        sums = np.concatenate([[0], np.cumsum(value, dtype=np.float64)])
        whole = _looked_up(*self.wholes, hashed(np.frombuffer(" ".join(words).encode("utf-8"), np.uint8))[2])[1]
        n = self.ratios.shape[1]
        self.ratios = np.concatenate([self.ratios, [sums[first + size - ORDER + 1] - sums[first], whole]], axis=1)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, of each model: the ratio over the whole text by its length, and over its 1, 3 and 10 most telling words."""
        split = [_WORDS(t.lower()) if t else [] for t in texts]
        if len(self.known) > 200_000:
            self.known, self.ratios = {}, np.zeros((2, 0))
        known = self.known
        fresh = {w for s in split for w in s if w not in known}
        if fresh:
            self.learn(sorted(fresh))
        out = np.zeros((len(texts), FEATURES))
        for k, s in enumerate(split):
            if not s:
                continue
            at = np.fromiter((known[w] for w in s), np.int64, len(s))
            for j, size in ((0, sum(map(len, s)) + len(s)), (1, len(s))):
                v = self.ratios[j][at if j == 0 else np.unique(at)]
                best = np.sort(np.partition(v, len(v) - 10)[-10:])[::-1] if len(v) > 10 else np.sort(v)[::-1]
                out[k, 4 * j : 4 * j + 4] = (10 * v.sum() / size, best[0], best[:3].sum() / 3, best.sum() / 10)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def calibrated(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression, balanced between classes, its intercept moved to the prior."""
    x = np.column_stack([x, np.ones(len(x))])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (each * (p - y)) + ridge * w
        h = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w /= scale
    w[-1] += math.log(prior / (1 - prior))
    return w


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in lean(batches):
        found, docs = Counter(), Counter()
        for label, part, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            mine = Counter(_WORDS((text or "").lower()))
            for w, n in mine.items():
                found[label, part, w] += n
                docs[label, part, w] += 1
        columns = [[k[j] for k in found] for j in range(3)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([docs[k] for k in found], pa.int64())],
            names=["toxic", "part", "word", "n", "d"],
        )
        b = found = docs = columns = None


def _model(counts: pa.Table) -> pa.Table:
    """The tables of one model from its rows (model, word, n0, n1, d0, d1); none if a class has no word."""
    words, (n0, n1, d0, d1) = counts["word"].to_pylist(), (counts[c].to_numpy() for c in ("n0", "n1", "d0", "d1"))
    rows = []
    if n0.any() and n1.any():
        rows = [(counts["model"][0].as_py(), *(x.tobytes() for x in (*kneser_ney(words, n0, n1), *whole_words(words, d0, d1))))]
    del words, n0, n1, d0, d1
    give_back()
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["model", "keys", "values", "word_keys", "word_values"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = 3000, folds: int = 4, seed: int = 5) -> Scorer:
    """A scorer from at most per_class labelled documents of each class, calibrated across folds.

    usable: a condition on labels' doc_id. The models of all rows and of all but each fold are built in tasks; the
    driver gets the hashed tables of the first and the features of the sample.
    """
    spark = docs.sparkSession
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = (rows if usable is None else rows.where(usable)).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Scorer.constant(float(bool(n.get(1))))
    # written and not made of the driver's rows, for which executors would start a second daemon with Python workers of its own
    chosen = written(rows.where("toxic = 0").orderBy("draw", "doc_id").limit(per_class).unionAll(rows.where("toxic = 1").orderBy("draw", "doc_id").limit(per_class)))
    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    part = F.pmod(F.shiftright("draw", 7), F.lit(folds)).cast("int").alias("part")
    drawn = drawn.select(F.col("toxic"), part, "text")
    prior = n[1] / (n[0] + n[1])
    # model k is counted without fold k; model `folds` has all
    of = lambda n, c, k: F.coalesce(F.sum(F.when((F.col("toxic") == c) & (F.col("part") != k), F.col(n))), F.lit(0)).alias(f"{n}{c}")
    counts = (
        drawn.mapInArrow(_words_of, "toxic int, part int, word string, n long, d long").groupBy("word")
        .agg(F.array(*(F.struct(F.lit(k).alias("model"), *(of(n, c, k) for n in "nd" for c in (0, 1))) for k in range(folds + 1))).alias("m"))
        .select("word", F.explode("m").alias("m")).select("word", "m.*").where("n0 + n1 > 0")
    )
    # models stay in the shared folder: a fold's rows are judged where its model is, and only the one that scores comes here
    built = written(counts.groupBy("model").applyInArrow(_model, "model int, keys binary, values binary, word_keys binary, word_values binary"))
    last = built.where(F.col("model") == folds).collect()
    if not last:
        return Scorer.constant(prior)
    scorer = Scorer.of(last[0], prior)
    del last
    judged = drawn.groupBy("part").cogroup(built.where(F.col("model") < folds).withColumnRenamed("model", "part").groupBy("part"))
    seen = judged.applyInArrow(_judged, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in seen])
    if len(set(y.tolist())) < 2:
        scorer.weights = np.array([0, 0, 1.0, 0, 0, 0, 1.0, 0, math.log(prior / (1 - prior)) - 3])
    else:
        order = np.lexsort(np.array([r["x"] for r in seen]).T)  # whatever the order of collection
        scorer.weights = calibrated(np.array([r["x"] for r in seen])[order], y[order], prior)
    return scorer


def _judged(rows: pa.Table, models: pa.Table) -> pa.Table:
    """Features of a fold's rows (toxic, part, text) by the model that was counted without them; none where there is no model."""
    if not models.num_rows:
        rows = rows.slice(0, 0)
        x = []
    else:
        judge = Scorer.of({k: models[k][0].as_py() for k in models.column_names}, 0.0)
        x = [f for b in rows.select(["text"]).to_batches(max_chunksize=128) for f in judge.features(b.column(0).to_pylist()).tolist()]
        del judge, models
    give_back()
    return pa.table([rows["toxic"].cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])


def scored(docs: DataFrame, scorer: Scorer, text_col: str = "text", column: str = "score", with_text: bool = True) -> DataFrame:
    """docs with a column of scores, and without the text if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text_col)
    kept = [k for k, c in enumerate(docs.columns) if with_text or k != at]
    names = [docs.columns[k] for k in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(shared.value.score(part.column(at).to_pylist()), pa.float64())], names=[*names, column])
            b = part = None

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema.fields[k] for k in kept))
    return docs.mapInArrow(run, f"{fields}, {column} double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted; held-out rows never take part in the fit."""
    scorer = fit(docs, labels, fold(F.col("doc_id"), 4) != 2)
    out = scored(docs.select("doc_id", "text"), scorer, with_text=False)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
