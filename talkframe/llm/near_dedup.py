"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct 5-word shingles; documents of equal sets and word sequences (128 bits of hashes that
aren't linear in bytes) form a class, which its smallest id stands for.
Each class has a signature of `coordinates` minima and is posted under (coordinate, value). Two sets of
similarity 0.75 agree in fewer than `matches` of 64 coordinates once in about a million times; pairs at or
above that threshold are confirmed on the full sets.

Prefix: a class's values are ordered by how many classes share them, rarest first; two classes with `matches`
values in common share one among the first coordinates - matches + 1 of each, so only those are posted, and
values that nobody shares take no posting. Skipping: a list whose members are in one component already has
nothing to add.

First each class is tried against the smallest member of its lists with which it shares most (one pair a class),
and what this links becomes components. Of lists of up to SMALL members that still hold several components, the
pairs across components are confirmed one by one if they agree in `matches` coordinates: a chain of lists that share
a member each, as chance makes them in a large table, costs no more than its lists. Longer lists that still hold
several components then form clusters, through their smallest members. In a cluster, classes outside its core (its largest component at that time, and whatever joins
it) are compared with all its members, in blocks: first with one block, which links most of them, then what is
left with every other block. A block
counts collisions of long sketches and confirms on full sets at once, so that only links leave a task, one for
each class and component met.

Defined results: words are separated by ASCII white space, A-Z are lower-cased; a text of fewer than five words
has its whole sequence as its only shingle; a null or empty text has an empty set, links with nothing and keeps
its own id; rows that repeat an id are one document, which every link of any of them reaches through (n_shingles is each row's
own); a row without an id is linked with nothing and is kept; a text of any length is read whole; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm import words
from talkframe.llm.bitmaps import pruned
from talkframe.llm.common import released, written
from talkframe.llm.graph import components, merged, roots

SHINGLE, COORDINATES, MATCHES, BLOCK = 5, 64, 30, 64
#: Members up to which a list's classes are paired by themselves.
SMALL = 64
#: Coordinates of the long sketches; two sets of similarity 0.75 agree in fewer than LONG_MATCHES once in millions.
LONG, LONG_MATCHES = 256, 156
_FACTORS = np.random.default_rng(11).integers(1, 2**63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's word hashes."""
    return np.unique(words.rolled(h, k)) if len(h) >= k else np.array([words.sequence(h)] if len(h) else [], np.uint64)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, h in words.of_texts(texts, lower=True):
        yield shingles_of(h)


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Minima of a nonempty set under each coordinate's order."""
    out = np.full(coordinates, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[at : at + 1024, None] * _FACTORS[:coordinates]).min(axis=0), out=out)
    return out


def sketch(shingles: np.ndarray) -> bytes:
    """Two bytes of each of the long coordinates: collisions are never too few, and too many only by chance."""
    return (words.mixed(signature(shingles, LONG)) >> np.uint64(48)).astype("<u2").tobytes()


def ordered(h: np.ndarray) -> int:
    """Hash of a word sequence that depends on every word and its place."""
    return int(words.mixed(h + np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)) if len(h) else 0


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, texts in words.blocks(b):
            n, low, high, sigs = [], [], [], []
            for _, _, h in words.of_texts(texts, lower=True):
                s = shingles_of(h)
                n.append(len(s))
                low.append(np.int64(np.uint64(s.sum(dtype=np.uint64))))
                high.append(np.int64(np.uint64(ordered(h))))
                sigs.append(signature(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "low", "high", "sig"],
            )


def _sets(with_sketch: bool):
    """(id, shingles) of texts, and their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in words.blocks(b):
                sets = list(shingle_sets(texts))
                columns = [b.column(0).slice(first, len(texts)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                if with_sketch:
                    columns.append(pa.array([sketch(s) for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "shingles", "sketch"][: len(columns)])

    return run


def _sets_of(ids: DataFrame, docs: DataFrame, with_sketch: bool) -> DataFrame:
    """Sets of the documents with these ids (id), whose texts alone are shuffled."""
    near = pruned(docs.where(F.col("id").isNotNull()), "id", ids).join(ids, "id", "left_semi")
    return near.mapInArrow(_sets(with_sketch), "id long, shingles array<long>" + ", sketch binary" * with_sketch)


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    sets = written(_sets_of(written(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()), docs, False))
    a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    possible = 100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(b, "b").join(a, "a").where(possible).where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _met(percent: int):
    """Links of the classes of one block to those of another, one for each class and component."""

    def block(b: pa.RecordBatch, row: int, at: int):
        ids, components_ = (b.column(at + c)[row].values.to_numpy() for c in (0, 1))
        sketches = np.frombuffer(b"".join(b.column(at + 2)[row].as_py()), "<u2").reshape(-1, LONG)
        sets = [s.values.to_numpy().view(np.uint64) for s in b.column(at + 3)[row].values]
        return ids, components_, sketches, sets, np.array([len(s) for s in sets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found_a, found_b = [], []
            for row in range(b.num_rows):
                ids, mine, sketches, sets, sizes = block(b, row, 0)
                ids2, theirs, sketches2, sets2, sizes2 = block(b, row, 4)
                for x in range(len(ids)):
                    ok = np.flatnonzero((theirs != mine[x]) & (100 * np.minimum(sizes2, sizes[x]) >= percent * np.maximum(sizes2, sizes[x])))
                    hits = (sketches2[ok] == sketches[x]).sum(axis=1)
                    linked = set()
                    for k in np.argsort(-hits, kind="stable").tolist():
                        if hits[k] < LONG_MATCHES:
                            break
                        y = int(ok[k])
                        if theirs[y] not in linked and similar(sets[x], sets2[y], percent):
                            linked.add(theirs[y])
                            found_a.append(min(ids[x], ids2[y]))
                            found_b.append(max(ids[x], ids2[y]))
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return run


def _blocks(members: DataFrame, sets: DataFrame, sizes: DataFrame, suffix: str) -> DataFrame:
    """Members of clusters in blocks of about BLOCK, with their sets."""
    rows = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).join(sets.withColumnRenamed("id", "rep"), "rep")
    columns = ("rep", "component", "sketch", "shingles")
    return (
        rows.groupBy("cluster", "block").agg(F.collect_list(F.struct(*columns)).alias("m"))
        .select("cluster", F.col("block").alias(f"block{suffix}"), *(F.col(f"m.{c}").alias(c + suffix) for c in columns))
    )


def _cores(members: DataFrame) -> DataFrame:
    """(cluster, core, blocks) of members (cluster, rep, component): the largest component and the number of blocks."""
    by = members.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    # a table of its own, so that the joins after it can split a hot cluster
    return written(by.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("core"), F.ceil(F.sum("n") / BLOCK).alias("blocks")))


def _links(members: DataFrame, clusters: DataFrame, sets: DataFrame, percent: int, first: bool) -> DataFrame:
    """Links of members (cluster, rep, component) outside their cluster's core: to the cluster's first block, or to all the others."""
    sizes = clusters.select("cluster", "blocks")
    outside = members.join(clusters.select("cluster", "core"), "cluster").where("component <> core").drop("core")
    left = _blocks(outside, sets, sizes, "")
    right = _blocks(members, sets, sizes, "2").where("block2 = 0" if first else "block2 <> 0")
    keys = left.select("cluster", "block").join(right.select("cluster", "block2"), "cluster")
    both = keys.join(left, ["cluster", "block"]).join(right, ["cluster", "block2"])
    names = ("rep", "component", "sketch", "shingles")
    return both.select(*names, *(f"{c}2" for c in names)).mapInArrow(_met(percent), "a long, b long").distinct()


def _agreeing(lists: DataFrame, reps: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) of classes in a list (token, rep, component) and in different components that agree in `matches` coordinates."""
    met = lists.groupBy("token").agg(F.collect_list(F.struct("rep", "component")).alias("m")).select("m", F.explode("m").alias("x"))
    across = met.select(F.col("x.rep").alias("a"), F.explode(F.expr("transform(filter(m, y -> y.rep > x.rep AND y.component <> x.component), y -> y.rep)")).alias("b"))
    pairs = written(across.distinct())
    a, b = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return pairs.join(a, "a").join(b, "b").where(same >= matches).select("a", "b").distinct()


def _labelled(df: DataFrame, comp: DataFrame, column: str, label: str) -> DataFrame:
    """df with the component of an id column as `label`; an id without links is its own."""
    return df.join(comp.select(F.col("id").alias(column), F.col("component").alias("__label")), column, "left").withColumn(label, F.coalesce("__label", column)).drop("__label")


def _linked(clusters: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components (id, component), of which `comp` are known, after all links inside clusters (rep, cluster).

    Both passes leave out the same core: whatever has not joined it by the second pass was compared with the first
    block in the first one. A component that outgrows the core in between is still compared with all blocks.
    """
    members = _labelled(clusters, comp, "rep", "component")
    cores = _cores(members)
    comp = merged(comp, written(_links(members, cores, sets, percent, True)))
    # a component's name is one of its members, so the core's name leads to the component that it is in now
    if cores.where("blocks > 1").isEmpty():  # the first block was all of every cluster
        return comp
    cores = written(_labelled(cores.withColumnRenamed("core", "was"), comp, "was", "core").select("cluster", "core", "blocks"))
    return merged(comp, written(_links(_labelled(clusters, comp, "rep", "component"), cores, sets, percent, False)))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, matches: int = MATCHES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_sign, "doc_id long, n_shingles long, low long, high long, sig array<long>"))
    light = signed.select("doc_id", "n_shingles", "low", "high")
    # a table of its own, so that the join after it can split a hot class
    classes = written(light.where("n_shingles > 0").groupBy("n_shingles", "low", "high").agg(F.min("doc_id").alias("rep")))
    member = written(light.where("doc_id is not null and n_shingles > 0").join(classes, ["n_shingles", "low", "high"]).select("doc_id", "rep"))
    reps = signed.join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    reps = written(reps.select(F.col("doc_id").alias("rep"), "sig"))

    tokens = reps.select("rep", F.posexplode("sig").alias("coordinate", "value")).select("rep", F.xxhash64("coordinate", "value").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    live = tokens.join(shared, "token")
    mine = Window.partitionBy("rep")
    posted = written(
        live.withColumns({"rank": F.row_number().over(mine.orderBy("df", "token")), "n": F.count("*").over(mine)})
        .where(F.col("rank") <= F.col("n") - (matches - 1)).select("token", "rep")
    )

    leaders = posted.groupBy("token").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    tried = (
        posted.join(leaders, "token").where("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("votes"))
        .groupBy("rep").agg(F.min_by("leader", F.struct(-F.col("votes"), "leader")).alias("leader"))
        .select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    )
    # an id's rows of different classes are one document
    several = written(member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a"))
    released(docs.sparkSession)
    # each class has one leader at most, which is smaller, so the first links are lines of parents
    comp = roots(_confirmed(written(tried), texts, percent).select(F.col("b").alias("id"), F.col("a").alias("parent")))
    if not several.isEmpty():
        comp = merged(comp, written(member.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))))

    released(docs.sparkSession)
    labelled = _labelled(posted, comp, "rep", "component")
    opened = written(labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("token", "n"))
    pairs = written(_agreeing(labelled.join(opened.where(F.col("n") <= SMALL).select("token"), "token"), reps, matches))
    comp = merged(comp, written(_confirmed(pairs, texts, percent)))
    released(docs.sparkSession)
    labelled = _labelled(written(posted.join(opened.where(F.col("n") > SMALL).select("token"), "token")), comp, "rep", "component")
    open_lists = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("leader")).where("lo <> hi")
    spokes = labelled.join(open_lists.select("token", "leader"), "token").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    clusters = components(spokes).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    sets = written(_sets_of(written(clusters.select(F.col("rep").alias("id"))), texts, True))
    released(docs.sparkSession)
    comp = _linked(clusters, comp, sets, percent)
    released(docs.sparkSession)

    final = member.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = light.select("doc_id", "n_shingles").join(final, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """docs without the rows that a smaller document of their component stands for."""
    gone = near_components(docs, id_col, text_col, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
