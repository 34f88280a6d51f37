"""Searches against plain versions over all rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkframe.llm import hard_negatives, lexical_search, nearest
from tests.llm import helpers as H

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
VECTORS = "vec_id long, embedding array<float>, label int"
EXTRA = ["'x' AS shard", "1 AS block", "2 AS key", "3 AS pivot", "'y' AS vector", "0 AS score", "5 AS low", "6 AS rank", "7 AS id"]

# --- 11 ranked lexical search


def searched(docs, items, k=10):
    """{item: [(doc_id, score)]} by scoring every document."""
    counted = [(d, Counter(TERMS(H.lowered(t)))) for d, t, *_ in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = {}
    for item in {i for i, _ in items}:
        texts = [t for i, t in items if i == item and t is not None]
        rows = []
        for d, c in counted if texts else []:
            m = 100 - 75 + 75 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in TERMS(H.lowered(min(texts))) if t in c)
            if score:
                rows.append((-score, d is None, d or 0))
        if rows:
            out[item] = [(None if null else d, -s) for s, null, d in sorted(rows)[:k]]
    return out


def got_by_item(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 1 << 30))
def test_lexical_search_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["Ünder", "ab1", "Ab1", "zz", "漢字", "q", "the", "of", "x-y"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([6, 39])]) for _ in range(n))
    docs = [(i // 2 * 2 if i % 17 == 0 else i, text(rng.choice([0, 1, 3, 30, 200])), None, None, None) for i in range(150)] + [(7, None, None, None, None), (None, text(9), None, None, None), (None, text(9), None, None, None)]
    items = [(i, text(rng.choice([1, 4, 20]))) for i in range(12)] + [(12, None), (13, "..."), (3, "zz"), (None, "q w3"), (14, "nowhere")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS rank")
    # segments of a few rows and items in several blocks
    got = got_by_item(lexical_search.lexical_search(H.frame(spark, docs, True), asked, block_chars=300, postings=rng.choice([1, 60, 100_000])))
    assert got == searched(docs, items)


def test_lexical_search_awkward(spark):
    items = [(1, "twelve héllo 漢字"), (2, "x"), (3, ""), (4, None)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got_by_item(lexical_search.lexical_search(H.frame(spark, H.AWKWARD, True), asked)) == searched(H.AWKWARD, items)
    assert lexical_search.lexical_search(H.frame(spark, []), asked).count() == 0
    assert lexical_search.lexical_search(H.frame(spark, H.AWKWARD), asked.limit(0)).count() == 0


def test_long_texts_are_counted_by_parts():
    text = ("é1 Word, " * 400_000).encode()
    assert lexical_search.term_counts(text) == {"é1".encode(): 400_000, b"word": 400_000}


def test_threshold_stops_early_and_ties_go_on():
    n = 20_000
    offsets = np.arange(0, 2 * n + 1, 2)
    term = np.tile([0, 1], n)
    impact = np.repeat(np.arange(n), 2)[::-1].copy()
    segment = lexical_search.Segment(offsets, term, impact)
    at, scores, reads = segment.search(np.array([0, 1]), np.array([2, 3]), np.array([2, 3]), 10)
    assert list(at) == list(range(10)) and reads < 500 and scores[0] == 5 * (n - 1)
    # a floor that none reaches ends the search after a block
    assert len(segment.search(np.array([0, 1]), np.array([2, 3]), np.array([2, 3]), 10, floor=10**9)[0]) == 0
    # equal scores everywhere: the threshold never falls below the k-th score
    segment = lexical_search.Segment(offsets, term, np.full(2 * n, 7))
    at, scores, reads = segment.search(np.array([0, 1]), np.array([2, 3]), np.array([2, 3]), 10)
    assert len(at) == n and reads == 2 * n


# --- vectors


def vectors(rng, n, dims=6, spread=1.0):
    centres = rng.normal(0, 1, (5, dims))
    rows = []
    for i in range(n):
        c = int(rng.integers(5))
        rows.append((i, [float(np.float32(v)) for v in centres[c] + rng.normal(0, spread, dims)], c))
    return rows


ODD = [
    (1000, None, 1), (1001, [], 1), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1003, [float("nan")] * 6, 2), (1004, [float("inf")] * 6, 2),
    (1100, [0.0] * 6, 1), (1006, [1.0] * 6, None), (None, [1.0] * 6, 1), (1008, [1.0] * 5, 1), (1009, [3e30] + [0.0] * 5, 3), (0, [9.0] * 6, 9), (1200, [0.5] * 6, 2),
] + [(1300 + i, [0.25] * 6, i % 3) for i in range(120)]


def plain_points(rows, label):
    best = {}
    for i, v, lab in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (lab is not None or not label):
            key = ((lab or 0) if label else 0, v)
            best[i] = min(best.get(i, key), key)
    return {i: (lab, v) for i, (lab, v) in best.items() if len(v) == 6}


def mined(rows):
    points = {i: (lab, [math.floor(256 * x) for x in v]) for i, (lab, v) in plain_points(rows, True).items()}
    out = set()
    for a, (label, q) in points.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, lab) for i, (lab, v) in points.items() if i != a)
        for p, pid, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(i, -s) for s, i, lab in scored if lab != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out |= {(a, pid, r, i, -p, s) for r, (i, s) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("size", [40, 4096])
def test_hard_negatives_equal_brute_force(spark, size):
    rng = np.random.default_rng(size)
    rows = vectors(rng, 330, spread=0.6) + [r for r in ODD if r[0] != 1009]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", *EXTRA)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, rows_per_shard=size, queries_per_block=3, sample=64).collect()
    assert len(got) == len(set(got)) and {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got} == mined(rows)


def test_hard_negatives_awkward(spark):
    ask = lambda rows: hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0)
    assert ask([]).count() == 0 and ask([(1, None, None)]).count() == 0 and ask([(100, [1.0], 1)]).count() == 0
    # equal vectors throughout: all scores tie and no negative is below nine tenths of them
    assert ask([(i, [1.0, 2.0], i % 2) for i in range(300)]).count() == 0
    # products beyond 64 bits end at the largest number
    assert ask([(0, [3e30, 1.0], 1), (1, [3e30, 2.0], 1), (2, [1.0, 1.0], 2)]).count() == 0


def test_far_shards_are_not_scanned():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(0, 0.02, (400, 8)) + np.eye(8)[rng.integers(0, 2, 400)]))
    most = float((x * x).sum(axis=1).max())
    pivots = hard_negatives.fitted_pivots(hard_negatives.augmented(x, most), 2)
    d = hard_negatives.distances(hard_negatives.augmented(x, most), pivots)
    near = d.argmin(axis=1)
    scanned = []

    class Counting(hard_negatives.Shard):
        def _scan(self, *args):
            scanned.append(1)
            return super()._scan(*args)

    for k in (0, 1):
        part = near == k
        shard = Counting(np.flatnonzero(part), np.zeros(part.sum(), int), x[part], near[part], d[part, k], pivots, most)
        q = x[near == 0][:1]
        floor = float(np.sort(x[near == 0] @ q[0])[-20])
        shard.search(q, np.array([-1]), np.array([0]), True, [[floor]], [[float("inf")]], 5)
    assert len(scanned) == 1


def nearest_plain(rows, k=10):
    points = {i: v for i, (_, v) in plain_points(rows, False).items() if any(v)}
    out = {}
    for q in (i for i in points if i % 100 == 0):
        out[q] = sorted((math.dist(points[q], v), i) for i, v in points.items() if i != q)[:k]
    return out


def test_nearest_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(9)
    rows = vectors(rng, 900) + ODD
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", *EXTRA)
    got = {}
    for r in sorted(nearest.nearest(df, F.col("vec_id") % 100 == 0, rows_per_shard=300, queries_per_block=4).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = nearest_plain(rows)
    assert got.keys() == want.keys()
    points = plain_points(rows, False)
    assert all(abs(s - math.dist(points[q][1], points[i][1])) <= 1e-9 * (1 + s) for q, near in got.items() for s, i in near)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))
    # one of many equal vectors: the smallest ids
    assert [i for _, i in got[1300]] == list(range(1301, 1311))


def test_nearest_recall_over_the_table(spark, sf="/root/testdata/sf0.1"):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in nearest.nearest(rows, F.col("vec_id") % 100 == 0, rows_per_shard=700).collect()}
    t = rows.toPandas()
    x, ids = np.stack(t["embedding"]).astype(float), t["vec_id"].to_numpy()
    true = set()
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:10]
        true |= {(ids[i], ids[j]) for j in order}
    assert len(got & true) >= 0.95 * len(true)


def test_nearest_awkward(spark):
    ask = lambda rows: [tuple(r) for r in nearest.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert ask([]) == [] and ask([(0, None, 1)]) == [] and ask([(0, [1.0, 0.0], 1)]) == []
    assert ask([(0, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (3, [1.0, 2.0], None), (4, [0.0, 0.0], 1)]) == [(0, 1, 5, 0.0), (0, 2, 3, 2.0)]


def test_graph_layers_are_nested_and_links_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (1500, 12))
    g = nearest.Graph(x, nearest._levels(np.arange(1500), 8), degree=8)
    for k, layer in enumerate(g.layers):
        used = np.flatnonzero((layer >= 0).any(axis=1))
        assert layer.shape[1] == (16 if k == 0 else 8) and (g.level[used] >= k).all() and (g.level[layer[layer >= 0]] >= k).all()
        assert all(len(set(row[row >= 0])) == (row >= 0).sum() and i not in row for i, row in enumerate(layer))
