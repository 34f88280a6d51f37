"""Words and their hashes from raw UTF-8, a block of texts at a time, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from talkframe.llm.common import SPACE_BYTES

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_Q = 0xD6E8FEB86659FD93
_Q_INV = pow(_Q, -1, 2**64)
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words longer than this are hashed one by one.
LONG_WORD = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and 64-bit hash of each word of a byte array.

    Eight bytes at a time go through a mixer that isn't linear, so no pattern of bytes makes words collide; words of
    more than LONG_WORD bytes take BLAKE2b.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate([[0], edge, [len(data)]]) if not space[0] else np.concatenate([edge, [len(data)]])
    starts, ends = edge[0 : len(edge) - 1 : 2], edge[1::2]
    size = ends - starts
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    h = mixed((eight[starts] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _SEED)
    at = np.flatnonzero(size > 8)
    for k in range(8, LONG_WORD, 8):
        if not len(at):
            break
        h[at] = mixed(h[at] * np.uint64(_Q) + (eight[starts[at] + k] & _FIRST[np.minimum(size[at] - k, 8)]))
        at = at[size[at] > k + 8]
    for i in at.tolist():
        h[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return starts, ends, h


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, by differences of running sums."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    most = 1 << len(h).bit_length()
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(most, _Q)[: len(h)], out=sums[1:])
    return mixed((sums[k:] - sums[:n]) * _powers(most, _Q_INV)[:n])


def summed(h: np.ndarray, k: int) -> np.ndarray:
    """32 more bits of each k consecutive word hashes, of another kind than `rolled`."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mixed(h ^ _SEED), out=sums[1:])
    return (mixed(sums[k:] - sums[:n]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sequence(h: np.ndarray) -> int:
    """Hash of a whole word sequence."""
    out = len(h)
    for x in h.tolist():
        out = (out * _Q + x) & 0xFFFFFFFFFFFFFFFF
    return int(mixed(np.array([out], np.uint64))[0])


def blocks(batch: pa.RecordBatch, size: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of a batch with about `size` bytes in column 1: first row and the texts; a null text is empty."""
    first, texts, total = 0, [], 0
    for i, t in enumerate(batch.column(1)):
        b = t.as_py()
        b = b"" if b is None else b.encode("utf-8") if isinstance(b, str) else b
        texts.append(b)
        total += len(b)
        if total >= size:
            yield first, texts
            first, texts, total = i + 1, [], 0
    if texts:
        yield first, texts


def of_texts(texts: list[bytes], lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text, starts, ends and hashes of its words; starts and ends count from the text's first byte."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends, h = hashed(data, lower)
    at = 0
    for t in texts:
        i, j = np.searchsorted(starts, (at, at + len(t)))
        yield starts[i:j] - at, ends[i:j] - at, h[i:j]
        at += len(t) + 1
