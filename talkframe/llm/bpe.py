"""Byte-level BPE encoding and decoding by merge replay.

A block of documents is one corpus: its distinct pieces lie side by side in one array of token ids, an inverted
index leads from each mergeable pair to the places where it stands, and merges are replayed over the whole block
in rank order. A merge touches its two neighbours only, and puts the pairs that it makes into the index. Ranks
of pairs are the ranks of their joined bytes; when a merge makes a pair of lower rank, the other places of the
current rank in that piece wait for it, which gives the same ids as merging each piece by itself.

Defined results: a null or empty text has no ids; pieces that are a token by themselves keep that token; a text
of any length is read whole; rows that repeat an id are encoded each; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import lean


class Bpe:
    """Ranks of a tiktoken file, and a memory of pieces encoded before: two turns of about `remember` pieces."""

    def __init__(self, path: str, pattern: str, remember: int = 250_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.single = [self.ranks[bytes((b,))] for b in range(256)]
        self.single_ids = np.array(self.single, np.int64)
        self.byte_pairs = np.array([[self.ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)], np.int64)
        self.find = regex.compile(pattern).findall
        self.remember = remember
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, int] = {}

    def _rank(self, key: int) -> int:
        """Rank of the joined bytes of the pair (key >> 32, key & 0xFFFFFFFF), or -1."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        r = self.pairs[key] = self.ranks.get(self.tokens[key >> 32] + self.tokens[key & 0xFFFFFFFF], -1)
        return r

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece, by one replay of the merges over all of them."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        sizes = np.array([len(p) for p in pieces], np.int64)
        of_ = np.repeat(np.arange(len(pieces)), sizes)
        ids, of = self.single_ids[raw].tolist(), of_.tolist()
        of.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank of the pair that starts at each place, or -1; and the index: rank -> places that had it
        first = np.append(np.where(of_[:-1] == of_[1:], self.byte_pairs[raw[:-1], raw[1:]], -1), -1) if n else np.zeros(0, np.int64)
        at_ = np.flatnonzero(first >= 0)
        at_ = at_[np.argsort(first[at_], kind="stable")]
        ranks_, cuts = np.unique(first[at_], return_index=True)
        places: list[list[int] | None] = [None] * len(self.tokens)
        for r, x in zip(ranks_.tolist(), np.split(at_, cuts[1:]), strict=False):
            places[r] = x.tolist()
        now, queue, pairs, rank = first.tolist(), ranks_.tolist(), self.pairs, self._rank
        while queue:
            r = heapq.heappop(queue)
            at, places[r] = places[r], None
            at.sort()
            waiting: set[int] = set()
            later: list[int] = []
            for i in at:
                if now[i] != r:
                    continue
                k = of[i]
                if waiting and k in waiting:
                    later.append(i)
                    continue
                j = after[i]
                ids[i], ids[j], now[j] = r, -1, -1
                j = after[i] = after[j]
                if of[j] == k:
                    before[j] = i
                    key = r << 32 | ids[j]
                    x = pairs.get(key)
                    if x is None:
                        x = rank(key)
                    now[i] = x
                    if x >= 0:
                        if places[x] is None:
                            places[x] = [i]
                            heapq.heappush(queue, x)
                        else:
                            places[x].append(i)
                        if x < r:
                            waiting.add(k)
                else:
                    now[i] = -1
                j = before[i]
                if j >= 0 and of[j] == k:
                    key = ids[j] << 32 | r
                    x = pairs.get(key)
                    if x is None:
                        x = rank(key)
                    now[j] = x
                    if x >= 0:
                        if places[x] is None:
                            places[x] = [j]
                            heapq.heappush(queue, x)
                        else:
                            places[x].append(j)
                        if x < r:
                            waiting.add(k)
            if later:
                if places[r] is None:
                    heapq.heappush(queue, r)
                    places[r] = later
                else:
                    places[r] += later
        left = np.array(ids, np.int64)
        alive = np.flatnonzero(left >= 0)
        ends = np.searchsorted(alive, np.cumsum(sizes))
        flat = left[alive].astype("<u4").tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, pieces: Iterable[str], block_bytes: int = 1 << 15) -> None:
        """Encode the pieces that aren't known yet, in blocks of bounded size."""
        todo: list[str] = []
        raw: list[bytes] = []
        size = 0
        for p in pieces:
            b = p.encode("utf-8")
            r = self.ranks.get(b)
            if r is not None:
                self.known[p] = r.to_bytes(4, "little")
                continue
            todo.append(p)
            raw.append(b)
            size += len(b)
            if size >= block_bytes:
                self._keep(todo, raw)
                todo, raw, size = [], [], 0
        self._keep(todo, raw)

    def _keep(self, pieces: list[str], raw: list[bytes]) -> None:
        if pieces:
            self.known.update(zip(pieces, self.replay(raw), strict=True))

    def encode_block(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        distinct = dict.fromkeys(texts)  # copies of a text are encoded once a block
        split = {t: self.find(t) for t in distinct}
        if len(self.known) > self.remember:  # what was met since the last turn stays for one more
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = set(chain.from_iterable(split.values())).difference(known)
        again = fresh.intersection(older)
        known.update((p, older[p]) for p in again)
        self.learn(sorted(fresh - again))
        for t, s in split.items():
            distinct[t] = b"".join(map(known.__getitem__, s))
        for t in texts:
            yield distinct[t]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def _blocks(b: pa.RecordBatch, chars: int) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows of a batch with about so many bytes of text."""
    ids, texts, size = [], [], 0
    for i, t in zip(b.column(0), b.column(1), strict=True):
        t = t.as_py() or ""
        ids.append(i.as_py())
        texts.append(t)
        size += len(t)
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1 << 20) -> DataFrame:
    """doc_id, token_ids (array<int>) and decoded (binary) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in lean(batches):
            for ids, texts in _blocks(b, block_chars):
                packed = list(c.encode_block(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32())), pa.array([c.decode(p) for p in packed], pa.binary())],
                    names=["doc_id", "token_ids", "decoded"],
                )
            b = ids = texts = packed = None

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, block_chars: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; ids and bytes stay inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in lean(batches):
            for ids, texts in _blocks(b, block_chars):
                rows, done = [], {}
                for p in c.encode_block(texts):
                    if p not in done:
                        done[p] = (len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(c.decode(p)).hexdigest())
                    rows.append(done[p])
                n, a, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            b = ids = texts = rows = done = None

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
