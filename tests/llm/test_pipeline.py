import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from talkframe.llm import mixing, queries, toxicity
from tests.llm import helpers as H
from tests.llm.test_operators import lines_removed, reference  # noqa: F401  (a fixture)

STAGES = dict(pipeline.STAGES)


def as_rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_queries_are_registered():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names and len([n for n in names if n.startswith("op")]) == 10
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline_equals_brute_force(spark, sf, reference):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}

    clean = STAGES["toxicity"](spark, docs, sf)
    assert clean.columns == columns
    left = dict(as_rows(clean))
    assert all(left[d] == t for d, t in as_rows(docs) if d in left)
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), toxicity.fold(toxicity.F.col("doc_id"), 4) != 2)
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs.select("doc_id", "text"), scorer).collect()}
    assert set(left) == {d for d, x in score.items() if x < pipeline.REJECTED}
    assert sum(labels.get(d) == 0 for d in left) >= 0.98 * sum(v == 0 for v in labels.values())

    lined = STAGES["line dedup"](spark, clean, sf)
    assert lined.columns == columns and dict(as_rows(lined)) == lines_removed(as_rows(clean))

    unique = STAGES["near dedup"](spark, lined, sf)
    component = H.near(as_rows(lined))
    assert unique.columns == columns and as_rows(unique) == [(d, t) for d, t in as_rows(lined) if component[d][1] == d]

    mixed = STAGES["mixing"](spark, unique, sf)
    assert mixed.columns == columns
    taken = {r["doc_id"]: r for r in mixing.mix(unique).collect()}
    copies = Counter(d for d, _ in as_rows(mixed))
    for d, r in taken.items():
        ratio = r["taken"] / r["size"] if r["size"] else 0
        assert int(ratio) <= copies[d] <= int(ratio) + (ratio > int(ratio)) <= 2
    # the words of a source stay within its largest document of what the mix takes
    for source in {r["source"] for r in taken.values()}:
        mine = [r for r in taken.values() if r["source"] == source]
        assert abs(sum(copies[r["doc_id"]] * r["size"] - r["taken"] for r in mine)) <= max(r["size"] for r in mine)
    assert as_rows(mixed) == as_rows(STAGES["mixing"](spark, unique.repartition(3), sf))

    got = sorted(map(tuple, STAGES["bpe"](spark, mixed, sf).collect()))
    want = []
    for d, t in as_rows(mixed):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_toxicity_stage_catches_toxic_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    left = {r["doc_id"] for r in STAGES["toxicity"](spark, docs, d).collect()}
    assert sum(x == 1 and i not in left for i, x in labels.items()) >= 0.75 * sum(x == 1 for x in labels.values())
    assert sum(x == 0 and i in left for i, x in labels.items()) >= 0.98 * sum(x == 0 for x in labels.values())


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(tuple, pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_awkward_rows(spark, sf, name):
    docs = H.frame(spark, H.AWKWARD, extra=True)
    out = STAGES[name](spark, docs, sf)
    assert out.count() >= (len(H.AWKWARD) - 1 if name not in ("mixing",) else 0)
    assert STAGES[name](spark, H.frame(spark, []), sf).count() == 0
    if name != "bpe":
        assert out.columns == docs.columns


def test_pipeline_leaves_no_rows_behind_and_tokens_decode(spark, sf):
    got = pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100
    assert P.PATTERN
