"""Embedding near-duplicates through a forest of random-projection trees."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.llm.common import components, map_arrow, written
from signpost.llm.vectors import dimension, is_usable, matrix, unit

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 8
LEAF_ROWS = 512
# Half width of the spill, in standard deviations of what a random direction makes of the widest link.
SPILL = 0.6
MISSED = 1e-4
SAMPLE_ROWS = 20_000
CHUNK_ROWS = 2_048
PAIRS_AT_ONCE = 16_384


class Tree:
    """One tree: at a node a random direction, cut where the two sides need the fewest comparisons.

    A row within ``margin`` of a cut goes to both sides. ``cuts`` holds the cut of a node, or none where
    no cut saves a tenth of the comparisons: such a node, a family of close vectors, stays a leaf.
    """

    def __init__(self, seed: int, depth: int, margin: float, cuts: dict[int, float | None] | None = None,
                 centres: dict[int, np.ndarray] | None = None):
        self.seed, self.depth, self.margin = seed, depth, margin
        self.cuts, self.centres = cuts or {}, centres or {}

    def fitted(self, sample: np.ndarray, enough: float) -> tuple:
        """What the tree is made of, once fitted on the sample; ``enough`` rows of it are a leaf."""
        self._fit(1, sample, 0, enough)
        return self.seed, self.depth, self.margin, self.cuts, self.centres

    def direction(self, node: int, size: int) -> np.ndarray:
        line = np.random.default_rng([self.seed, node]).standard_normal(size)
        return line / np.linalg.norm(line)

    def _fit(self, node: int, rows: np.ndarray, level: int, enough: float) -> None:
        if level == self.depth:
            return
        if len(rows) <= enough:
            self.cuts[node] = None
            return
        if len(rows) < 32:
            # Deeper than the sample reaches, nodes are cut at their projected centre.
            if len(rows):
                self.centres[node] = rows.mean(axis=0)
            return
        along = rows @ self.direction(node, rows.shape[1])
        order = np.sort(along)
        at = order[len(order) // 10:-(len(order) // 10)]
        left = np.searchsorted(order, at + self.margin, "right") / len(order)
        right = 1 - np.searchsorted(order, at - self.margin, "left") / len(order)
        work = left ** 2 + right ** 2
        best = int(np.argmin(work))
        if work[best] > 0.9:
            self.cuts[node] = None
            return
        cut = self.cuts[node] = float(at[best])
        self._fit(2 * node, rows[along <= cut + self.margin], level + 1, enough)
        self._fit(2 * node + 1, rows[along >= cut - self.margin], level + 1, enough)

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, leaf, whether the leaf is a node left whole)``; a row near a cut goes to both sides."""
        out_row, out_leaf, out_whole = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
        stack = [(1, 0, np.arange(len(rows)), np.zeros(rows.shape[1]))]
        while stack:
            node, level, here, centre = stack.pop()
            if not len(here):
                continue
            whole = node in self.cuts and self.cuts[node] is None
            if whole or level == self.depth:
                out_row.append(here)
                out_leaf.append(np.full(len(here), node, np.int64))
                out_whole.append(np.full(len(here), whole))
                continue
            line = self.direction(node, rows.shape[1])
            along = rows[here] @ line
            centre = self.centres.get(node, centre)
            cut = self.cuts[node] if node in self.cuts else float(centre @ line)
            stack.append((2 * node, level + 1, here[along <= cut + self.margin], centre))
            stack.append((2 * node + 1, level + 1, here[along >= cut - self.margin], centre))
        return np.concatenate(out_row), np.concatenate(out_leaf), np.concatenate(out_whole)


def trees_for(depth: int, least: int = TREES, missed: float = MISSED) -> int:
    """Trees so that a link at the limit is missed by all with about this probability.

    A cut parts such a link with a probability of about 0.025: its difference along the direction must
    exceed the spill of both sides, 1.2 standard deviations, and the cut must fall between.
    """
    lost = 1 - 0.975 ** depth
    return max(least, math.ceil(math.log(missed) / math.log(lost))) if depth else 1


def similar_pairs(vectors: DataFrame, cosine: float = 0.9, trees: int | None = None, leaf_rows: int = LEAF_ROWS, spill: float = SPILL,
                  sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """``(a, b)`` with a < b: ids of distinct vectors (``vec_id, embedding``) found with this cosine or more.

    Every tree splits the unit vectors in turn along random directions, until a leaf would hold
    ``leaf_rows`` or no cut of a node saves comparisons. A row within the margin of a cut goes to both sides:
    ``spill`` standard deviations of the projected difference of two vectors at this cosine, whatever the
    spread of the node, so that a family's links are not parted at greater depth. ``trees`` grow with the
    depth (:func:`trees_for`). The cuts are fitted on a sample of about ``sample_rows`` rows, those whose
    id hashes lowest; every row is put in its leaves. Rows of a leaf are dealt into chunks of about
    ``CHUNK_ROWS`` rows and any two chunks meet in a task of their own, so that a leaf of very many
    rows (a family of near copies) is compared in many tasks. Pairs are verified in double
    precision; a pair that several leaves find is returned once. Of the nodes left whole a row lies in, the
    first is its home: pairs of one home are handed on from there alone.
    """
    total = vectors.count()
    size = dimension(vectors)
    if not total:
        return vectors.sparkSession.createDataFrame([], "a long, b long")
    share = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(seed)), 11) / float(1 << 53)
    sample = [r[0] for r in vectors.where(share < sample_rows / total).select("embedding").limit(2 * sample_rows).collect()]
    sample = unit(np.array(sample)) if sample else np.empty((0, size))
    depth = max(0, math.ceil(math.log2(total / leaf_rows)))
    trees = trees or trees_for(depth)
    margin = spill * math.sqrt(max(0.0, 2 - 2 * cosine) / max(1, size))
    enough = leaf_rows * len(sample) / total
    forest = vectors.sparkSession.sparkContext.broadcast([Tree(seed + t, depth, margin).fitted(sample, enough) for t in range(trees)])

    def route():
        grown = [Tree(*parts) for parts in forest.value]

        def run(batch: pa.RecordBatch):
            if not batch.num_rows:
                return
            rows = unit(matrix(batch.column(1)))
            places = [tree.leaves(rows) for tree in grown]
            home = np.full(len(rows), -1, np.int64)
            for t, (row, leaf, whole) in reversed(list(enumerate(places))):
                # Of several nodes of one tree the least, as the last one written stays.
                last = np.argsort(-leaf[whole], kind="stable")
                home[row[whole][last]] = (np.int64(t) << 48) + leaf[whole][last]
            for t, (row, leaf, _) in enumerate(places):
                yield [np.full(len(row), t, np.int32), leaf, home[row], batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))]
        return run

    placed = written(map_arrow(
        vectors.select("vec_id", "embedding"), route, "tree int, leaf long, home long, vec_id long, embedding array<double>"), "leaves")
    counts = placed.groupBy("tree", "leaf").agg(F.count("*").alias("rows")).where("rows > 1").select(
        "tree", "leaf", F.ceil(F.col("rows") / CHUNK_ROWS).cast("int").alias("chunks"))
    dealt = placed.join(written(counts, "counts"), ["tree", "leaf"]).select(
        "tree", "leaf", "home", "vec_id", "embedding", "chunks", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"))
    # A chunk goes to its meeting with every chunk of the leaf, itself included.
    meets = dealt.select("tree", "leaf", "home", "vec_id", "embedding", "chunk", F.explode(F.expr("sequence(0, chunks - 1)")).alias("other"))
    meets = meets.select("tree", "leaf", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "home", "vec_id", "embedding")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        place = (group["tree"][0].as_py() << 48) + group["leaf"][0].as_py()
        ids, chunk, home = (group[c].to_numpy() for c in ("vec_id", "chunk", "home"))
        rows = unit(matrix(group["embedding"].combine_chunks()))
        left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(left), 512):
            part = left[at:at + 512]
            near_i, near_j = np.nonzero(rows[part] @ rows[right].T >= cosine - 1e-9)
            # In a family nearly all pairs are close: their vectors are not laid out side by side at once.
            for begin in range(0, len(near_i), PAIRS_AT_ONCE):
                i, j = part[near_i[begin:begin + PAIRS_AT_ONCE]], right[near_j[begin:begin + PAIRS_AT_ONCE]]
                new = (ids[i] != ids[j]) & ((low != high) | (i < j))
                new &= (home[i] != home[j]) | (home[i] < 0) | (home[i] == place)
                i, j = i[new], j[new]
                # Products of many rows at once may differ in the last place from those of two rows.
                true = (rows[i] * rows[j]).sum(axis=1) >= cosine
                first, second = ids[i[true]], ids[j[true]]
                a.append(np.minimum(first, second))
                b.append(np.maximum(first, second))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return meets.groupBy("tree", "leaf", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, **how) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``embeddings``.

    Equal vectors are one class; classes are linked by :func:`similar_pairs`. ``n_links`` counts
    the other rows linked directly, rows of the same vector among them, ``component_id`` is the
    smallest ``vec_id`` reachable by links, itself included, and ``kept`` marks the row of that id.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Rows without a ``vec_id`` link and count like others; with no id in reach their component is
    null and they are not kept. Of rows that repeat an id with other vectors, each has the links
    of its own vector. Other columns are ignored.
    """
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # Adding 0.0 makes one zero of the two.
    rows = written(all_rows.where(is_usable()).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))), "vectors")
    classes = rows.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("rows"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    pairs = written(similar_pairs(classes.select(F.col("key").alias("vec_id"), "embedding"), cosine, **how), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = classes.select("key", "rows")
    links = written(both.join(count, both.b == count.key).groupBy("a").agg(F.sum("rows").alias("linked")), "linked")
    member = components(pairs)
    known = classes.join(links, classes.key == links.a, "left").join(member, classes.key == member.node, "left").select(
        "embedding", "least", "rows", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "key").alias("root"))
    known = written(known, "known")
    roots = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    labels = written(known.join(roots, "root").select("embedding", (F.col("linked") + F.col("rows") - 1).alias("n_links"), "component_id"), "labels")
    linked = rows.join(labels, "embedding").select("vec_id", "n_links", "component_id")
    others = all_rows.where(~is_usable()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(others).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
