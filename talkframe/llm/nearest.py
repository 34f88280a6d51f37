"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

1. Shards. Vectors are dealt out by a hash of their ids; equal vectors of a shard are one node with all their ids, so
   that a vector that repeats doesn't fill its neighbours' links with itself.
2. Graphs. A node's level is drawn by its hash; a layer holds the nodes of its level and above. Layers are built from
   the top, nodes of higher levels first, some nodes at a time: they search the layer from the nearest node of the
   layer above, choose links that lead in different directions, and their neighbours drop links beyond the limit by
   the same rule. Each layer is one flat array, a row of links a node; the graphs are a table in the shared folder.
3. Search. Queries meet every shard, in blocks: down the layers from one entry, then a beam over the lowest one, many
   queries in step. Distances of what the beam holds are taken again in double precision from the original vectors.
4. The best of the shards are merged.

Defined results: rows without an id or a whole finite vector other than zero take no part; of rows that repeat an id
the smallest vector counts; vectors of another length than most take no part; a query is compared with every row but
its own; equal distances go by ascending id; with fewer candidates than k all of a shard's are found; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.common import written
from talkframe.llm.vectors import against, lists, matrix, usable

_NODES = "shard int, node int, level int, vec_ids array<bigint>, vector array<double>, links array<array<int>>"


def _near(x: np.ndarray, squares: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its nodes."""
    return np.maximum(0, squares[at] + (q * q).sum(axis=1)[:, None] - 2 * np.matmul(x[at], q[:, :, None])[:, :, 0])


class Graph:
    """Layers of flat link arrays over the rows of x; -1 is no link."""

    def __init__(self, x: np.ndarray, level: np.ndarray, layers: list[np.ndarray] | None = None, degree: int = 16, beam: int = 64, together: int = 256):
        self.x = (x / max(1e-300, float(np.abs(x).max(initial=0.0))))
        self.squares = (self.x * self.x).sum(axis=1)
        self.level, self.layers, self.degree, self.beam = level, layers or [], degree, beam
        self.top = int(np.flatnonzero(level == level.max())[0])
        if layers is None:
            self._build(together)

    def _build(self, together: int) -> None:
        order = np.argsort(-self.level, kind="stable")
        self.layers = [np.zeros(0)] * (int(self.level.max()) + 1)
        for layer in range(len(self.layers) - 1, -1, -1):
            width = self.degree * (2 if layer == 0 else 1)
            self.layers[layer] = np.full((len(self.x), width), -1, np.int32)
            nodes = order[: int((self.level >= layer).sum())]
            placed = int((self.level > layer).sum())
            # nodes of the layer above come first: it leads to them
            batches = [nodes[a : min(a + together, placed)] for a in range(0, placed, together)] + [nodes[a : a + together] for a in range(placed, len(nodes), together)]
            self.placed, inside = np.zeros(len(self.x), bool), 0
            for new in batches:
                self._insert(layer, new, inside, nodes)
                self.placed[new] = True
                inside += len(new)

    def _insert(self, layer: int, new: np.ndarray, inside: int, nodes: np.ndarray) -> None:
        """Link new nodes with those already inside the layer and with each other."""
        q, width = self.x[new], self.layers[layer].shape[1]
        # of each other, the nearest
        own = np.maximum(0, self.squares[new][None, :] + self.squares[new][:, None] - 2 * (q @ q.T))
        np.fill_diagonal(own, np.inf)
        few = min(len(new) - 1, self.degree)
        ids, dist = np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0))
        if few > 0:
            at = np.argpartition(own, few - 1, axis=1)[:, :few]
            ids, dist = new[at], np.take_along_axis(own, at, axis=1)
        if inside:
            entry = self._down(q, layer)
            # until the layer above is placed as a whole, what it leads to may not be in yet
            entry = np.where(self.placed[entry], entry, nodes[0])
            found, far = self._beam(layer, q, entry[:, None], self.beam)
            far = np.where((found < 0) | (found == new[:, None]), np.inf, far)
            ids, dist = np.concatenate([found, ids], axis=1), np.concatenate([far, dist], axis=1)
        if not ids.shape[1]:
            return
        chosen = self._chosen(ids, dist, self.degree)
        self.layers[layer][new[:, None], np.arange(chosen.shape[1])[None, :]] = chosen
        # links back: those beyond the limit are chosen by the same rule
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, first, n = np.unique(target, return_index=True, return_counts=True)
        most = int(n.max(initial=0))
        if not most:
            return
        added = np.full((len(touched), most), -1, np.int64)
        added[np.repeat(np.arange(len(touched)), n), np.arange(len(target)) - np.repeat(first, n)] = source
        held = self.layers[layer][touched]
        added[(added[:, :, None] == held[:, None, :]).any(axis=2)] = -1
        ids = np.concatenate([held, added], axis=1)
        room = (ids >= 0).sum(axis=1) <= width
        packed = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), axis=1)[:, :width]
        full = np.flatnonzero(~room)
        for part in np.array_split(full, max(1, len(full) // 512)):
            if len(part):
                dist = _near(self.x, self.squares, self.x[touched[part]], ids[part])
                packed[part] = self._chosen(ids[part], np.where(ids[part] < 0, np.inf, dist), width)
        self.layers[layer][touched] = packed

    def _chosen(self, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of each row's ids: nearest first, those nearer to the row than to one chosen before, then the rest."""
        order = np.argsort(dist, axis=1, kind="stable")[:, : 3 * most]
        ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
        v, there = self.x[ids], np.isfinite(dist)
        squares = self.squares[ids]
        between = squares[:, None, :] + squares[:, :, None] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            closer = np.where(taken, between[:, j, :], np.inf).min(axis=1)
            taken[:, j] = there[:, j] & (dist[:, j] < closer) & (taken.sum(axis=1) < most)
        rank = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(np.where(there, ids, -1), rank, axis=1)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((len(out), most - out.shape[1]), -1)], axis=1)
        return out

    def _down(self, q: np.ndarray, layer: int) -> np.ndarray:
        """The node of the layer above that is nearest, going down from the top one."""
        entry = np.full(len(q), self.top)
        for above in range(len(self.layers) - 1, layer, -1):
            entry = self._beam(above, q, entry[:, None], 1)[0][:, 0]
        return entry

    def _beam(self, layer: int, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and distances of the nearest that a beam of this width finds, nearest first."""
        links, rows = self.layers[layer], len(q)
        ids = np.full((rows, width), -1, np.int64)
        dist, done = np.full((rows, width), np.inf), np.zeros((rows, width), bool)
        ids[:, : entry.shape[1]] = entry
        dist[:, : entry.shape[1]] = _near(self.x, self.squares, q, entry)
        seen = np.zeros((rows, len(self.x)), bool)
        seen[np.arange(rows)[:, None], entry] = True
        active = np.arange(rows)
        while len(active):
            open_ = np.where(done[active], np.inf, dist[active])
            best = open_.argmin(axis=1)
            going = np.isfinite(open_[np.arange(len(active)), best])
            active, best = active[going], best[going]
            if not len(active):
                break
            done[active, best] = True
            met = links[ids[active, best]]
            fresh = (met >= 0) & ~seen[active[:, None], met]
            seen[active[:, None], np.where(fresh, met, ids[active, best][:, None])] = True
            far = np.where(fresh, _near(self.x, self.squares, q[active], met), np.inf)
            all_far = np.concatenate([dist[active], far], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            dist[active] = np.take_along_axis(all_far, order, axis=1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], met], axis=1), order, axis=1)
            done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(far.shape, bool)], axis=1), order, axis=1)
        return np.where(np.isfinite(dist), ids, -1), dist

    def search(self, queries: np.ndarray, scale: float, beam: int, together: int = 256) -> np.ndarray:
        """Nodes (-1: none) that the beam holds for each query, which is divided by scale as the vectors were."""
        out = []
        for a in range(0, len(queries), together):
            q = (queries[a : a + together] / scale)
            out.append(self._beam(0, q, self._down(q, 0)[:, None], min(beam, len(self.x)))[0])
        return np.concatenate(out) if out else np.zeros((0, 0), np.int64)


def _levels(ids: np.ndarray, degree: int) -> np.ndarray:
    """Each id's level: geometric, drawn by a mixing of its bits."""
    h = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 1
    return np.minimum(8, -np.log(u / 2.0**53) / np.log(degree)).astype(np.int32)


def graphs(points: DataFrame, shards: int, degree: int = 16, beam: int = 64) -> DataFrame:
    """A row for each node: shard, node, level, vec_ids (ascending), vector, and its links on each of its layers."""

    def run(rows: pa.Table) -> pa.Table:
        ids, x = rows.column("vec_id").to_numpy(), matrix(rows.column("vector"))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        nodes, first, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
        by = np.argsort(of.ravel(), kind="stable")
        members = np.split(ids[by], np.cumsum(np.bincount(of.ravel()))[:-1])
        level = _levels(ids[first], degree)
        graph = Graph(nodes, level, degree=degree, beam=beam)
        return pa.table({
            "shard": pa.array([rows.column("shard")[0].as_py()] * len(nodes), pa.int32()), "node": pa.array(np.arange(len(nodes), dtype=np.int32)), "level": pa.array(level),
            "vec_ids": pa.array([m.tolist() for m in members], pa.list_(pa.int64())), "vector": lists(nodes),
            "links": pa.array([[layer[i][layer[i] >= 0].tolist() for layer in graph.layers[: level[i] + 1]] for i in range(len(nodes))], pa.list_(pa.list_(pa.int32()))),
        })

    dealt = points.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, _NODES)


def _loaded(nodes: pa.Table, degree: int) -> tuple[Graph, np.ndarray, list]:
    """The graph of a shard's rows, its vectors and each node's ids."""
    nodes = nodes.take(pa.array(np.argsort(nodes.column("node").to_numpy())))
    x, level, links = matrix(nodes.column("vector")), nodes.column("level").to_numpy(), nodes.column("links").to_pylist()
    layers = [np.full((len(x), degree * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(level.max()) + 1)]
    for i, of_node in enumerate(links):
        for layer, to in zip(layers, of_node, strict=False):
            layer[i, : len(to)] = to
    return Graph(x, level, layers, degree), x, nodes.column("vec_ids").to_pylist()


def found(index: DataFrame, queries: DataFrame, k: int, beam: int = 128, degree: int = 16) -> DataFrame:
    """query_id, vec_id and score: of each shard and block that queries share with the index, the nearest k that its beam holds."""

    def run(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        out_query, out_id, out_score = [], [], []
        if nodes.num_rows and asked.num_rows:
            graph, x, members = _loaded(nodes, degree)
            q, ids = matrix(asked.column("vector")), asked.column("vec_id").to_numpy()
            held = graph.search(q, max(1e-300, float(np.abs(x).max())), max(beam, k + 1))
            for i, at in enumerate(held):
                at = at[at >= 0]
                far = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                # of equal vectors the smallest ids are enough
                near = [(d, m) for d, node in zip(far.tolist(), at.tolist(), strict=True) for m in members[node][: k + 1] if m != ids[i]]
                near.sort()
                out_query += [ids[i]] * min(k, len(near))
                out_id += [m for _, m in near[:k]]
                out_score += [d for d, _ in near[:k]]
        return pa.table({"query_id": pa.array(out_query, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_score, pa.float64())})

    asked = queries.select("shard", "block", "vec_id", "vector")
    return index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(
    rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    rows_per_shard: int = 8192, queries_per_block: int = 8192, degree: int = 16, build_beam: int = 64, beam: int = 192,
) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found; queries: a condition on vec_id."""
    points = written(usable(rows, id_col, vector_col).where(F.exists("vector", lambda c: c != 0)))
    shards = max(1, -(-points.count() // rows_per_shard))
    index = written(graphs(points, shards, degree, build_beam))
    held, asked = against(index, points.where(queries).select("vec_id", "vector"), shards, queries_per_block)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found(held, asked, k, beam, degree).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
