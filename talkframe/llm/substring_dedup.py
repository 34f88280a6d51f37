"""Substring dedup by repeated-phrase automata.

A window is `span` consecutive words. Each word of a document goes that stands in a window whose words also
stand, as a window, in a document of smaller id.

1. Anchors. Of the `gram`-word hashes inside a window the smallest is its anchor, so equal windows have equal
   anchors, and about one word in four starts one. Anchors of at least two documents go into a bitmap of fixed
   size (a bounded broadcast: with more anchors it only prunes less).
2. Confirmed passages. Windows whose anchor may be shared are counted by hash; those of two documents are
   confirmed, and the smallest document is the owner of the window. Windows are told apart by 96 bits of hashes that aren't linear in
   bytes: of 10**13 different windows two collide with a chance below 10**-2. An owner's confirmed windows, joined
   where they adjoin, are its passages; their words, not their hashes, go on.
3. Sharded automata. Documents with a window of another owner are dealt over shards of bounded size, those of the
   same main owner together (many of them split), and each shard gets the passages of its documents' owners, once. It compiles the anchor phrases of their windows into
   one Aho-Corasick automaton over word numbers and streams its documents through it, whole; each match grows
   both ways along the passage, and a run of a window's length counts when its owner is smaller than the
   document. Words are compared, so a collision can't remove a word; it could only leave one.

Defined results: a null text has no words; a row without an id keeps all its words and takes none from others;
rows that repeat an id are one document and take nothing from each other; a text of any length is read whole;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm import words
from talkframe.llm.bitmaps import PAGE, pruned, slots_of
from talkframe.llm.common import written

SPAN, GRAM, BITS, DOCS_PER_SHARD = 13, 7, 1 << 27, 256
#: bytes.split() without arguments separates at exactly the six white-space bytes that separate words here.
_find = bytes.split


class _Block:
    """The windows of a block of documents: their documents, anchors, hashes, and the first places of anchors among the block's words."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], span: int, gram: int):
        data = np.frombuffer(b" ".join(texts), np.uint8)
        starts, _, self.h = words.hashed(data)
        self.span, self.n = span, max(0, len(self.h) - span + 1)
        firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
        row = np.searchsorted(firsts, starts, side="right") - 1
        self.inside = np.flatnonzero(row[: self.n] == row[span - 1 :]) if self.n else np.zeros(0, np.int64)
        self.doc = ids[row[self.inside]] if self.n else np.zeros(0, np.int64)
        self.grams, self.reach = words.rolled(self.h, gram), span - gram + 1
        low = self.grams[: self.n].copy()
        for j in range(1, self.reach):
            np.minimum(low, self.grams[j : self.n + j], out=low)
        self.lowest, self.low = low, low[self.inside]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each window, and 32 bits of another."""
        return words.rolled(self.h, self.span)[self.inside], words.summed(self.h, self.span)[self.inside]

    def places(self) -> np.ndarray:
        """The first place of each window's anchor."""
        first = np.arange(self.n)
        for j in range(self.reach - 1, -1, -1):
            hit = np.flatnonzero(self.grams[j : self.n + j] == self.lowest)
            first[hit] = hit + j
        return first[self.inside]


def _blocks(batches, span, gram) -> Iterator[_Block]:
    for b in batches:
        ids = b.column(0).to_numpy()
        for first, texts in words.blocks(b):
            yield _Block(ids[first : first + len(texts)], texts, span, gram)


def _together(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """An order in which equal pairs of key and document stand together."""
    return np.argsort(key + doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _ends(*key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of each run of equal keys."""
    if not len(key[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
    return first, np.concatenate([first[1:], [len(key[0])]]) - 1


def _anchors(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, span, gram):
            low, doc = block.low, block.doc
            change = np.ones(len(low), bool)
            change[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            low, doc = low[change], doc[change]
            order = _together(low, doc)
            a = np.sort(low[order][_ends(low[order], doc[order])[0]])  # an anchor once a document
            first, last = _ends(a)
            yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array((last - first + 1).astype(np.int64))], names=["anchor", "n"])

    return run


def _candidates(span: int, gram: int, bits: int, anchors, confirmed=None):
    """Windows whose anchor may be shared, with the smallest and largest document of the block; or, where a bitmap
    of confirmed windows is given, those that may be confirmed, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def may(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
            slot = (keys & np.uint64(bits - 1)).astype(np.int64)
            return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

        shared = np.frombuffer(anchors.value, np.uint8)
        known = None if confirmed is None else np.frombuffer(confirmed.value, np.uint8)
        for block in _blocks(batches, span, gram):
            ok = np.flatnonzero(may(shared, block.low))
            w, m = (x[ok] for x in block.windows())
            d = block.doc[ok]
            if known is None:
                order = np.argsort(w)
                w, m, d = w[order], m[order], d[order]
                first, _ = _ends(w, m)
                lo, hi = (f.reduceat(d, first) if len(d) else d for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(w[first].view(np.int64)), pa.array(m[first]), pa.array(lo), pa.array(hi)], names=["window", "more", "lo", "hi"])
            else:
                hit = may(known, w)
                w, m, d = w[hit], m[hit], d[hit]
                order = _together(w, d)
                w, m, d = w[order], m[order], d[order]
                first, _ = _ends(w, m, d)
                yield pa.RecordBatch.from_arrays([pa.array(w[first].view(np.int64)), pa.array(m[first]), pa.array(d[first])], names=["window", "more", "doc"])

    return run


def _bitmap(keys: DataFrame, key: str, bits: int):
    """A broadcast of bits / 8 bytes that has the keys' slots set."""
    table = np.zeros(bits // 8, np.uint8)
    for page, content in slots_of(keys, F.col(key).bitwiseAND(F.lit(bits - 1))).collect():
        table[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(content, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table.tobytes())


def passages_of(text: bytes, confirmed: np.ndarray, span: int = SPAN) -> list[bytes]:
    """The words of each maximal stretch of confirmed windows, joined by blanks."""
    _, _, h = words.hashed(np.frombuffer(text, np.uint8))
    at = np.flatnonzero(np.isin(words.rolled(h, span), confirmed))
    if not len(at):
        return []
    found = _find(text)
    cut = np.flatnonzero(np.diff(at) > 1)
    return [b" ".join(found[i : j + span]) for i, j in zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist(), strict=True)]


def _passages(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[p.decode("utf-8") for p in passages_of((t.as_py() or "").encode("utf-8"), c.values.to_numpy().view(np.uint64), span)] for t, c in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["owner", "passages"])

    return run


class Phrases:
    """Passages of a shard, and an Aho-Corasick automaton of the anchor phrases of their windows.

    An anchor phrase is the `gram` words in a window with the smallest hash, so a window that stands in a document
    brings its anchor phrase along. The automaton runs over numbers of words (from 1), two signs for each; where it finds a phrase, the
    match grows both ways over equal words, and a run of at least `span` words counts.
    """

    def __init__(self, span: int, gram: int):
        self.span, self.gram = span, gram
        self.passages: list[tuple[int, bytes]] = []
        self.automaton: ahocorasick.Automaton | None = None

    def add(self, owner: int, passage: bytes) -> None:
        self.passages.append((owner, passage))
        self.automaton = None

    def compile(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.number: dict[bytes, int] = {}
        self.places: list[list[int]] = []
        texts = [p for _, p in self.passages]
        found = _find(b" ".join(texts))
        number = self.number
        for w in found:
            if w not in number:
                number[w] = len(number) + 1
        ids = [number[w] for w in found]
        # word positions with a place that equals nothing (-1) before each passage
        first = _Block(np.arange(len(texts)), texts, self.span, self.gram).places()
        self.base = math.isqrt(len(number)) + 1
        signs = self._signs(np.array(ids, np.int64))
        sizes = np.array([t.count(b" ") + 1 for t in texts], np.int64)
        shift = np.repeat(np.arange(len(texts)), sizes) + 1
        self.flat = np.full(len(ids) + len(texts) + 1, -1, np.int64)
        self.flat[np.arange(len(ids)) + shift] = ids
        self.near = self.flat.tolist()
        self.owners = np.repeat([o for o, _ in self.passages], sizes + 1).tolist() + [0]
        seen: dict[tuple, int] = {}
        for at in np.unique(first).tolist():
            key = tuple(ids[at : at + self.gram])
            k = seen.setdefault(key, len(self.places))
            if k == len(self.places):
                self.places.append([])
                self.automaton.add_word(signs[2 * at : 2 * (at + self.gram)], k)
            self.places[k].append(at + int(shift[at]))
        if len(self.automaton):
            self.automaton.make_automaton()

    def _signs(self, ids: np.ndarray) -> tuple[int, ...]:
        """Two signs for each word number, from two ranges: few branches at a node, and no match between words."""
        return tuple(np.stack([ids // self.base, ids % self.base + self.base + 1], axis=1).reshape(-1).tolist())

    def gone(self, doc: int, found: list[bytes]) -> bytearray:
        """1 for each word of a document that stands in a phrase of a smaller one."""
        if self.automaton is None:
            self.compile()
        gone = bytearray(len(found))
        if not len(self.automaton) or len(found) < self.span:
            return gone
        get, flat, near, owners, reach, gram, n = self.number.get, self.flat, self.near, self.owners, self.span - self.gram, self.gram, len(found)
        ids = [get(w, 0) for w in found]  # 0 stands in no phrase
        mine = np.array(ids, np.int64)
        upto: dict[int, int] = {}  # by diagonal, where the last run ended
        for end, k in self.automaton.iter(self._signs(mine)):
            end //= 2
            p = end - gram + 1
            # every window around this phrase is gone already: copies and repetitive texts cost no more than others
            low, high = max(0, p - reach), end + 1 + reach
            if gone.find(0, low, high) < 0:
                continue
            for q in self.places[k]:
                if owners[q] >= doc or upto.get(p - q, -1) > p:
                    continue
                # a few words beside the phrase say whether a window can match
                x, y, least = p - 1, q - 1, max(0, p - reach)
                while x >= least and ids[x] == near[y]:
                    x, y = x - 1, y - 1
                left, x, y, most = x + 1, end + 1, q + gram, min(n, high)
                while x < most and ids[x] == near[y]:
                    x, y = x + 1, y + 1
                if x - left >= self.span:
                    left, right = _grown(mine, flat, left, left - p + q, x - left)
                    upto[p - q] = right
                    gone[left:right] = b"\x01" * (right - left)
                    if gone.find(0, low, high) < 0:
                        break
        return gone


def _grown(a: np.ndarray, b: np.ndarray, p: int, q: int, size: int) -> tuple[int, int]:
    """The longest range of a around a[p : p + size] that equals b around b[q : q + size]."""
    left, step = p, 64
    while left > 0:
        n = min(step, left, left - p + q)
        if n <= 0:
            break
        differ = np.flatnonzero(a[left - n : left] != b[left - p + q - n : left - p + q])
        if len(differ):
            left -= n - 1 - int(differ[-1])
            break
        left, step = left - n, step * 4
    right, step = p + size, 64
    while right < len(a):
        n = min(step, len(a) - right, len(b) - (right - p + q))
        if n <= 0:
            break
        differ = np.flatnonzero(a[right : right + n] != b[right - p + q : right - p + q + n])
        if len(differ):
            right += int(differ[0])
            break
        right, step = right + n, step * 4
    return left, right


def _row(i, found: list[bytes], gone: bytearray | None, with_text: bool) -> tuple:
    left = found if gone is None or 1 not in gone else [w for w, g in zip(found, gone, strict=True) if not g]
    kept = b" ".join(left)
    return (i, len(found), len(found) - len(left), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8")] if with_text else []))


def _batch(rows: list[tuple], with_text: bool) -> pa.RecordBatch:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=False)], names=names)


def _stream(span: int, gram: int, with_text: bool):
    """Rows by shard, passages (owner, passages) before documents (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, phrases = None, None
        for b in batches:
            out = []
            for s, i, text, passages in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if s != shard:
                    shard, phrases = s, Phrases(span, gram)
                if passages.is_valid:
                    for p in passages.as_py():
                        phrases.add(i, p.encode("utf-8"))
                else:
                    found = _find((text.as_py() or "").encode("utf-8"))
                    out.append(_row(i, found, phrases.gone(i, found), with_text))
            yield _batch(out, with_text)

    return run


def _whole(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([_row(i, _find((t.as_py() or "").encode("utf-8")), None, with_text) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)], with_text)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, bits: int = BITS, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    Documents without a window of another owner never leave their task (but for hash collisions in a bitmap).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = docs.where(F.col("id").isNotNull()).select("id", F.col("text").cast("binary").alias("text"))
    shared = rows.mapInArrow(_anchors(span, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    anchors = _bitmap(shared, "anchor", bits)
    owned = written(
        rows.mapInArrow(_candidates(span, gram, bits, anchors), "window long, more int, lo long, hi long")
        .groupBy("window", "more").agg(F.min("lo").alias("owner"), F.max("hi").alias("hi")).where("owner < hi").select("window", "more", "owner")
    )
    held = rows.mapInArrow(_candidates(span, gram, bits, anchors, _bitmap(owned, "window", bits)), "window long, more int, doc long")
    # an owner's own rows keep their windows, all others only say how many windows of which owners a document has
    links = written(
        held.join(owned, ["window", "more"]).groupBy("doc", "owner", F.when(F.col("doc") == F.col("owner"), F.col("window")).alias("window")).agg(F.count("*").alias("n"))
    )
    pairs = links.where("doc <> owner").select("doc", "owner", "n")

    confirmed = links.where("doc = owner").groupBy("owner").agg(F.collect_list("window").alias("confirmed"))
    owners = pruned(docs.withColumnRenamed("id", "owner"), "owner", pairs.select("owner").distinct())
    passages = (
        owners.join(confirmed, "owner").select("owner", "text", "confirmed").mapInArrow(_passages(span), "owner long, passages array<string>")
        .groupBy("owner").agg(F.flatten(F.collect_list("passages")).alias("passages"))  # of rows that repeat an id
    )

    # documents of one main owner go together, so that its passages are sent and compiled once; many of them are split
    main = pairs.groupBy("doc").agg(F.max_by("owner", F.struct("n", -F.col("owner"))).alias("main"))
    main = written(main)
    many = written(main.groupBy("main").agg(F.ceil(F.count("*") / DOCS_PER_SHARD).alias("parts")))  # a table of its own, so that the join can split a hot owner
    touched = written(main.join(many, "main").select("doc", F.xxhash64("main", F.pmod(F.xxhash64("doc"), F.col("parts"))).alias("place")))
    shards = -(-touched.count() // DOCS_PER_SHARD) or 1
    shard = F.pmod(F.coalesce("place", F.xxhash64("doc")), F.lit(shards)).alias("shard")
    sent = pairs.join(touched, "doc").select(shard, "owner").distinct().join(passages, "owner").select("shard", F.col("owner").alias("id"), F.lit(None).cast("string").alias("text"), "passages")
    none = F.lit(None).cast("array<string>")
    inside = pruned(docs.withColumnRenamed("id", "doc"), "doc", touched.select("doc")).join(touched, "doc", "left").select(shard, F.col("doc").alias("id"), "text", none.alias("passages"))
    outside = pruned(docs.withColumnRenamed("id", "doc"), "doc", touched.select("doc"), outside=True).select("doc", "text")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    streamed = (
        sent.unionAll(inside).repartition("shard").sortWithinPartitions("shard", F.col("passages").isNull())
        .mapInArrow(_stream(span, gram, with_text), schema)
    )
    return streamed.unionAll(outside.mapInArrow(_whole(with_text), schema))
