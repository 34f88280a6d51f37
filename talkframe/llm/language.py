"""Language identification by a bidirectional gated recurrent network over bytes.

One gated recurrent unit reads a window of bytes forwards, another backwards; a softmax over both states labels
every position, and a document's probabilities are the mean over all its positions. The network is trained here,
in numpy, by backpropagation through time (Adam). Texts are read whole, as consecutive windows of `WINDOW` bytes.

Training takes at most `per_language` labelled documents a language, chosen by a seeded hash of the id among those of
at most `longest` bytes; both bounds on rows are parameters. Their texts are used whole, as consecutive windows, and
there are as many steps as it takes to see each window at least once. Only bytes reach the network.

Defined results: a null text and a text without a letter are `und` with score 0; without any labelled row every
text is `und`; rows that repeat an id are predicted each; ties go to the first language in code-point order; an
empty table gives an empty result; a text of any length is predicted whole; other columns pass unchanged or, in
`language_id`, are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import fold

WINDOW, HIDDEN, PAD = 128, 8, 256
_HOLD = 60.0  # input of the update gate at padding: the state stays as it is


class Direction:
    """A gated recurrent unit. Columns are windows: inputs (T, N), states (T + 1, H, N).

    w: (3H, 257) input weights by byte, with the biases; u: (3H, H). Rows: update gate z, reset gate r, candidate.
    h' = z * h + (1 - z) * tanh(w_n[x] + r * (u_n h)).
    """

    def __init__(self, w: np.ndarray, u: np.ndarray):
        self.w, self.u, self.h = w, u, u.shape[1]

    @classmethod
    def random(cls, rng: np.random.Generator, hidden: int) -> Direction:
        w = rng.normal(0, 0.3, (3 * hidden, 257)).astype(np.float32)
        w[:hidden] += 1.0
        d = cls(w, rng.normal(0, 0.7 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32))
        d.pad()
        return d

    def pad(self) -> None:
        self.w[:, PAD] = 0
        self.w[: self.h, PAD] = _HOLD

    def forward(self, x: np.ndarray, keep: bool = False):
        """States after each step; with keep, also gates, candidates and u_n h for `backward`."""
        t_n, n, k = x.shape[0], x.shape[1], self.h
        dtype = self.w.dtype
        half = self.w.copy()
        half[: 2 * k] *= 0.5
        u = self.u.copy()
        u[: 2 * k] *= 0.5
        states = np.zeros((t_n + 1, k, n), dtype)
        kept = (np.empty((t_n, 2 * k, n), dtype), np.empty((t_n, k, n), dtype), np.empty((t_n, k, n), dtype)) if keep else None
        a, g = np.empty((3 * k, n), dtype), np.empty((3 * k, n), dtype)
        for t in range(t_n):
            h, new = states[t], states[t + 1]
            np.take(half, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=g)
            gates, cand = a[: 2 * k], a[2 * k :]
            gates += g[: 2 * k]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            if keep:
                kept[0][t], kept[2][t] = gates, g[2 * k :]
            g[2 * k :] *= gates[k:]
            cand += g[2 * k :]
            np.tanh(cand, out=cand)
            if keep:
                kept[1][t] = cand
            np.subtract(h, cand, out=new)
            new *= gates[:k]
            new += cand
        return states, kept

    def backward(self, x: np.ndarray, states: np.ndarray, kept, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and u, given those of the states after each step (T, H, N)."""
        k = self.h
        dw, du = np.zeros_like(self.w), np.zeros_like(self.u)
        dh = np.zeros_like(states[0])
        rows = np.arange(3 * k)[:, None]
        for t in range(x.shape[0] - 1, -1, -1):
            dh = dh + up[t]
            h, z, r, c, uh = states[t], kept[0][t][:k], kept[0][t][k:], kept[1][t], kept[2][t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * uh * r * (1 - r)
            into = np.concatenate([dz, dr, dc])
            np.add.at(dw, (rows, x[t][None, :]), into)
            through = np.concatenate([dz, dr, dc * r])
            du += through @ h.T
            dh = dh * z + self.u.T @ through
        dw[:, PAD] = 0
        return dw, du


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # (C, 2H + 1)

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.w, self.forward.u, self.backward.w, self.backward.u, self.out]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, C, N) of every position of windows (T, N)."""
        f = self.forward.forward(x)[0][1:]
        b = self.backward.forward(x[::-1])[0][1:][::-1]
        k = f.shape[1]
        logits = np.matmul(self.out[:, :k], f)
        logits += np.matmul(np.ascontiguousarray(self.out[:, k : 2 * k]), b)
        logits += self.out[:, 2 * k :]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions that aren't padding, and its gradients."""
        sf, kf = self.forward.forward(x, keep=True)
        sb, kb = self.backward.forward(x[::-1], keep=True)
        f, b = sf[1:], sb[1:][::-1]
        k = f.shape[1]
        logits = np.matmul(self.out[:, :k], f) + np.matmul(self.out[:, k : 2 * k], b) + self.out[:, 2 * k :]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        real = (x != PAD).astype(p.dtype)
        total = max(1.0, float(real.sum()))
        hot = np.zeros((p.shape[1], x.shape[1]), p.dtype)
        hot[y, np.arange(x.shape[1])] = 1
        loss = -float((np.log(np.maximum((p * hot).sum(axis=1), 1e-12)) * real).sum()) / total
        d = (p - hot) * real[:, None, :] / p.dtype.type(total)
        both = np.concatenate([f, b, np.ones_like(f[:, :1])], axis=1)
        dout = np.einsum("tcn,tkn->ck", d, both, optimize=True)
        df = np.matmul(np.ascontiguousarray(self.out[:, :k].T), d)
        db = np.matmul(np.ascontiguousarray(self.out[:, k : 2 * k].T), d)
        return loss, [*self.forward.backward(x, sf, kf, df), *self.backward.backward(x[::-1], sb, kb, db[::-1]), dout]

    def document_probabilities(self, texts: list[bytes], columns: int = 2048) -> np.ndarray:
        """A row for each text: the mean of its positions' probabilities (zeros for an empty text)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.concatenate([np.frombuffer(b"".join(texts), np.uint8), np.zeros(WINDOW, np.uint8)])
        first = np.cumsum(sizes) - sizes
        n = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(texts)), n)
        start = first[doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
        left = np.minimum(first[doc] + sizes[doc] - start, WINDOW)
        sums = np.zeros((len(texts), len(self.languages)))
        step = np.arange(WINDOW)[:, None]
        for at in range(0, len(doc), columns):
            s, size = start[at : at + columns], left[at : at + columns]
            real = step < size[None, :]
            x = np.where(real, data[s[None, :] + step].astype(np.int64), PAD)
            p = self.positions(x)
            if (size < WINDOW).any():
                p *= real[:, None, :]
            np.add.at(sums, doc[at : at + columns], p.sum(axis=0).T)
        return sums / np.maximum(sizes, 1)[:, None]

    def label_positions(self, text: bytes) -> list[str]:
        """The language of every byte of a text."""
        out = []
        for at in range(0, len(text), WINDOW):
            x = np.frombuffer(text[at : at + WINDOW], np.uint8).astype(np.int64)[:, None]
            out += [self.languages[i] for i in self.positions(x)[:, :, 0].argmax(axis=1)]
        return out


def windows_of(texts: list[bytes], length: int) -> np.ndarray:
    """All consecutive windows of whole texts, a row each; the last one of a text is padded."""
    out = np.full((sum(-(-len(t) // length) for t in texts), length), PAD, np.int16)
    at = 0
    for t in texts:
        n = -(-len(t) // length)
        out[at : at + n].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
        at += n
    return out


def train(samples: list[tuple[str, bytes]], steps: int = 300, batch: int = 256, length: int = 64, hidden: int = HIDDEN, rate: float = 0.02, seed: int = 3) -> Network:
    """A network from (language, whole text) rows, in at least `steps` steps; each has as many windows of every language."""
    rng = np.random.default_rng(seed)
    languages = sorted({s for s, t in samples if t})
    by = [windows_of([t for s, t in samples if s == lang], length) for lang in languages]
    net = Network(languages, Direction.random(rng, hidden), Direction.random(rng, hidden), rng.normal(0, 0.3, (len(languages), 2 * hidden + 1)).astype(np.float32))
    if len(languages) < 2:
        return net
    each = max(1, batch // len(languages))
    steps = max(steps, -(-max(map(len, by)) // each))
    y = np.repeat(np.arange(len(languages)), each)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    turns = [rng.permutation(len(w)) for w in by]
    for step in range(1, steps + 1):
        x = np.concatenate([np.take(w, turn[np.arange((step - 1) * each, step * each) % len(w)], axis=0) for w, turn in zip(by, turns, strict=True)]).T.astype(np.int64)
        _, grads = net.gradients(x, y)
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads))
        lr = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            p -= np.float32(lr) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-8))
        net.forward.pad()
        net.backward.pad()
    return net


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, longest: int = 1 << 18, length: int = 64, seed: int = 9) -> Network | None:
    """A network from a bounded sample of the usable rows with a language; None without any."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("b"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("draw")
    )
    # each language is an output of the network, so its counts are few; one that has only longer texts learns from its shortest
    short = F.length("b") <= longest
    seen = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_if(short).alias("n")).collect()}
    if not seen:
        return None
    n, rare = {lang: k for lang, k in seen.items() if k}, [lang for lang, k in seen.items() if not k]
    got = [(r["lang"], r["draw"], bytes(r["b"])) for r in rows.where(F.col("lang").isin(rare)).groupBy("lang").agg(F.min_by(F.struct("draw", "b"), F.struct(F.length("b"), "draw")).alias("x")).select("lang", "x.*").collect()] if rare else []
    # enough of each language in expectation, then the first by hash; the driver never sees more than a few times the bound
    share = F.lit(0.0) if not n else F.element_at(F.create_map(*(x for lang, k in n.items() for x in (F.lit(lang), F.lit(1_000_003 * 2.0 * per_language / k)))), F.col("lang"))
    drawn = rows.where(short & (F.pmod("draw", F.lit(1_000_003)) < share)) if n else None
    got = sorted(got + [(r["lang"], r["draw"], bytes(r["b"])) for r in (drawn.collect() if n else [])])
    taken: dict[str, list] = {}
    for lang, _, text in got:
        if len(taken.setdefault(lang, [])) < per_language:
            taken[lang].append(text)
    return train([(lang, t) for lang, texts in taken.items() for t in texts], length=length)


def predicted(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """docs' columns without the text, and lang_pred and score."""
    others = [c for c in docs.columns if c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for at, end in _parts(b.column(b.num_columns - 2)):
                part = b.slice(at, end - at)
                texts = ["" if t is None else t for t in part.column(part.num_columns - 2).to_pylist()]
                letters = part.column(part.num_columns - 1).to_pylist()
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if net is not None:
                    p = net.document_probabilities([t.encode("utf-8") if ok else b"" for t, ok in zip(texts, letters, strict=True)])
                    best = p.argmax(axis=1)
                    for k, ok in enumerate(letters):
                        if ok:
                            lang[k], score[k] = net.languages[best[k]], float(min(1.0, p[k, best[k]]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*others, "lang_pred", "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != text_col)
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*others, F.col(text_col), has_letter.alias("__letter")).mapInArrow(run, f"{fields}lang_pred string, score double")


def _parts(texts: pa.Array, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges with about so many bytes of text."""
    first, size = 0, 0
    for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()):
        size += n
        if size >= chars:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; rows of fold 1 of 3 never take part in the fit."""
    net = fit(docs, fold(F.col("doc_id"), 3) != 1)
    return predicted(docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text"), net)
