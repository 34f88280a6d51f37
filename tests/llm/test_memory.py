"""What operators leave in a Python worker that goes on to later stages."""

import ctypes
import re
from pathlib import Path

import public_tokenizers as P
import pyarrow as pa
import pytest

from talkframe.llm import bpe, queries, toxicity


class Tasks:
    """A frame that hands out the function of its tasks."""

    columns = ["doc_id", "text"]

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def idle_mb(run, batches):
    """MB that the allocators hold free once a task is over."""

    def anonymous():
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    def trim():
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)

    trim()
    for _ in run(batches):
        pass
    before = anonymous()
    trim()
    return before - anonymous()


def texts():
    for k in range(2):
        rows = ["".join(chr(97 + (i * 7 + j * j + k) % 26) + " " * (j % 5 == 0) for j in range(700)) for i in range(20_000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows)], names=["doc_id", "text"])


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc only")
def test_workers_give_memory_back(spark):
    assert idle_mb(bpe.digests(Tasks(), queries.VOCABULARY, P.PATTERN), texts()) < 4


def test_fit_makes_no_frame_of_the_drivers_rows(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")

    def refused(*a, **b):
        raise AssertionError("executors start Python workers of another kind for it")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    assert toxicity.scored(docs, toxicity.fit(docs, labels)).count() == docs.count()
