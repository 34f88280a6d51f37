r"""Ranked lexical search by Fagin's threshold algorithm.

1. Forward index. Each document becomes one row: how many terms it has, and of the items' terms those that it holds
   with their occurrences. Its rows are written once; counts over all documents come from them.
2. Lists. A task reads its rows segment by segment. Of a segment it makes one list for each term, sorted by impact,
   and keeps the forward index beside it for random lookups.
3. Search. For each item its lists are read in turn, a block of postings from each; a document that is met for the
   first time is looked up in the forward index, which gives its whole score. The threshold is what a document could
   score that stands in no list so far; the search stops once it is strictly below the k-th score, or no list has more.
   A task keeps the best of earlier segments, so that later ones stop sooner.
4. The best of the tasks are merged: k rows an item and task.

Nothing is gathered by term, so that a term of every document costs no more than its postings where they lie. Segments
are bounded in postings, and items go out in blocks bounded in characters; of each block the documents are read anew.

Defined results: a null text, or one without terms, is in no list and isn't counted; rows that repeat a document's id
are documents of their own; one without an id takes part and comes after others of its score; rows that repeat an
item's id are one item, of the smallest text; an item without terms has no rows; equal scores go by ascending id; texts
of any length are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.common import written

#: Bytes that terms consist of, A-Z lower-cased: digits, letters, and all bytes of characters beyond ASCII.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of a text whose terms are counted at once.
_PART = 1 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, a part at a time."""
    flat, at = text.translate(_TERM_BYTES), 0
    while at < len(flat):
        end = flat.find(b" ", at + _PART)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def term_counts(text: bytes) -> Counter:
    found: Counter = Counter()
    for part in terms(text):
        found.update(part)
    return found


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The part of a score that a term's occurrences in a document make, before its weight."""
    if len(n) and 75 * int(n.max()) * docs >= 1 << 63:
        share = np.array([75 * int(x) * docs // total for x in n], np.int64)
    else:
        share = 75 * n * docs // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * (25 + share))


class Segment:
    """Impact-sorted lists and the forward index of some documents, which come in ascending order of their ids."""

    def __init__(self, offsets: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.offsets, self.term, self.impact = offsets, term, impact
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        order = np.lexsort((owner, -impact, term))
        self.doc, self.sorted = owner[order], impact[order]
        self.lists, first = np.unique(term[order], return_index=True)
        self.bounds = np.append(first, len(order))
        self.seen = np.zeros(len(offsets) - 1, bool)

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores by the forward index; weight: of every term, 0 for those that the item hasn't."""
        sizes = self.offsets[docs + 1] - self.offsets[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.offsets[docs] - (ends - sizes), sizes)
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], ends - sizes)

    def search(self, asked: np.ndarray, weights: np.ndarray, weight: np.ndarray, k: int, floor: int = 0, block: int = 32) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and scores of the best k (more where scores tie, fewer where they are below floor), and how many postings were read.

        floor: a score that k documents elsewhere reach.
        """
        at = np.searchsorted(self.lists, asked)
        held = (at < len(self.lists)) & (weights > 0)
        held[held] = self.lists[at[held]] == asked[held]
        position, end, by = self.bounds[at[held]].copy(), self.bounds[at[held] + 1], weights[held]
        self.seen[:] = False
        docs, scores, reads = [], np.zeros(0, np.int64), 0
        while (more := position < end).any():
            upto = np.minimum(position + block, end)
            met = self.doc[np.concatenate([np.arange(a, b) for a, b in zip(position[more], upto[more], strict=True)])]
            reads, position = reads + len(met), upto
            fresh = np.unique(met[~self.seen[met]])
            if len(fresh):
                self.seen[fresh] = True
                docs.append(fresh)
                scores = np.concatenate([scores, self.scores(fresh, weight)])
            # what stands behind the place that each list is read to
            threshold = int((by * self.sorted[position - 1])[position < end].sum())
            least = max(floor, int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0)
            if threshold < least:
                break
            block *= 2
        if not docs:
            return np.zeros(0, np.int64), scores, reads
        all_docs = np.concatenate(docs)
        keep = (scores >= max(1, floor, int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0))
        return all_docs[keep], scores[keep], reads


def forward_index(docs: DataFrame, number: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n and the arrays term and tf of each document with a term; number: of the terms that are indexed."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in batches:
            ids, n, sizes, term, tf = [], [], [0], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = term_counts(text.as_py() or b"")
                if not found:
                    continue
                held = [(number[t], c) for t, c in found.items() if t in number]
                ids.append(doc)
                n.append(found.total())
                term.extend(t for t, _ in held)
                tf.extend(c for _, c in held)
                sizes.append(len(term))
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))],
                names=["doc_id", "n", "term", "tf"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<bigint>")


def _segments(batches: Iterable[pa.RecordBatch], postings: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        ends = np.asarray(b.column(2).offsets)
        at = 0
        while at < b.num_rows:
            # as many rows as the segment has room for, one at least
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + postings - size, "right")) - 1)
            held.append(b.slice(at, end - at))
            size += int(ends[min(end, b.num_rows)] - ends[at])
            at = end
            if size >= postings or at < b.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    sizes = pc.list_value_length(column).to_numpy()
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pc.list_flatten(column).to_numpy().astype(np.int64)


def _ranked(index: DataFrame, items: list[tuple], weight: np.ndarray, docs: int, total: int, k: int, postings: int) -> DataFrame:
    """item, doc_id and score of the best k of each task. items: of each its terms' numbers and how often it has them."""
    shared = index.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        of_all = np.zeros(len(weight), np.int64)
        for t in _segments(batches, postings):
            ids = t.column("doc_id").combine_chunks()
            t = t.take(pa.array(np.lexsort((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())))))
            ids = t.column("doc_id").combine_chunks()
            offsets, term = _lists(t.column("term"))
            tf = _lists(t.column("tf"))[1]
            n = np.repeat(np.asarray(t.column("n")), np.diff(offsets))
            segment = Segment(offsets, term, impacts(tf, n, docs, total))
            key, missing = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
            for i, (asked, times) in enumerate(items):
                score, doc, null = best[i]
                weights = weight[asked] * times
                of_all[asked] = weights
                at, got, _ = segment.search(asked, weights, of_all, k, int(score[-1]) if len(score) == k else 0)
                of_all[asked] = 0
                if len(at):
                    score, doc, null = np.append(score, got), np.append(doc, key[at]), np.append(null, missing[at])
                    order = np.lexsort((doc, null, -score))[:k]
                    best[i] = score[order], doc[order], null[order]
        for i, (score, doc, null) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(score), pa.int32()), pa.array(doc, pa.int64(), mask=null), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text",
    block_chars: int = 1 << 22, postings: int = 1 << 20,
) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents that score highest for each item, above 0.

    block_chars: of the items that are searched together; postings: of a segment.
    """
    spark = docs.sparkSession
    asked = items.groupBy(F.col(item_col).alias("item_id")).agg(F.min(query_col).alias("text")).where("text IS NOT NULL")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_chars))
    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        counted = [(r["item_id"], c) for r in rows if (c := term_counts(r["text"].encode("utf-8")))]
        number = {t: i for i, t in enumerate(sorted({t for _, c in counted for t in c}))}
        index = written(forward_index(docs, number, id_col, text_col))
        n, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["term"]: r["count"] for r in index.select(F.explode("term").alias("term")).groupBy("term").count().collect()}
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(number))], np.int64)
        numbered = [(np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for _, c in counted]
        of_item = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(counted)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = _ranked(index, numbered, weight, n, total, k, postings).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found.append(written(top.join(F.broadcast(of_item), "item").select("item_id", "rank", "doc_id", "score")))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out
