"""Hard negatives by exact inner-product search over lists that the anchors of a cluster share."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.common import discard, map_arrow, written
from signpost.llm.vectors import matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIVES = 5
NEGATIVES = 10
# Anchors from which the clusters' centres are learned, and the most clusters there are.
SAMPLE_ANCHORS = 4_096
CLUSTERS = 256
ANCHORS_EACH = 128
# Anchors and candidates that meet in one task.
CHUNK_ANCHORS = 256
CHUNK_ROWS = 4_096
# Candidates scored at once along a list.
STRIDE = 512
# A component beyond this cannot be scored in 64 bits.
GREATEST = 1 << 24
# Bounds are raised by this share of both lengths, beyond what rounding can take from them.
SLACK = 1e-6
_LEAST, _MOST = -(1 << 62), 1 << 62


def _prepared(vectors: DataFrame, scale: int) -> DataFrame:
    """``key, vec_id, label, q``: the rows that take part, each once, with whole numbers for components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= GREATEST))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite)
    lengths = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths:
        rows = rows.where(F.size("embedding") == lengths["size"])
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", changed.alias("label"), F.transform("embedding", lambda x: F.floor(x * scale).cast("int")).alias("q"))
    return rows.distinct().withColumn("key", F.monotonically_increasing_id())


def _centres(anchors: DataFrame, count: int, seed: int) -> np.ndarray:
    """Unit centres of ``count`` clusters by direction, from a sample of the anchors."""
    sample = np.array([r.q for r in anchors.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ANCHORS).select("q").collect()], np.float64)
    length = np.sqrt((sample * sample).sum(axis=1, keepdims=True))
    sample = (sample / np.maximum(length, 1.0))[length[:, 0] > 0]
    if not len(sample):
        return np.ones((1, len(anchors.first().q)))
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(8):
        own = (sample @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            total = sample[own == c].sum(axis=0)
            size = math.sqrt(float(total @ total))
            if size > 1e-9:
                centres[c] = total / size
    return centres


def _angles(rows: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of rows and their angles to a unit centre; a row of zeros is at the centre."""
    length = np.sqrt((rows * rows).sum(axis=1))
    return length, np.arccos(np.clip(np.where(length > 0, rows @ centre / np.maximum(length, 1e-300), 1.0), -1.0, 1.0))


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with ``cell`` (their nearest centre), ``angle`` to it and ``length``."""
    def make():
        norms = np.sqrt((centres * centres).sum(axis=1))
        unit = centres / norms[:, None]

        def run(batch: pa.RecordBatch):
            if not batch.num_rows:
                return
            x = matrix(batch.column(3))
            cell = (x @ unit.T).argmax(axis=1)
            length, angle = np.zeros(len(x)), np.zeros(len(x))
            for c in np.unique(cell):
                length[cell == c], angle[cell == c] = _angles(x[cell == c], unit[c])
            yield [*batch.columns, cell.astype(np.int32), angle, length]
        return run

    return map_arrow(rows.select("key", "vec_id", "label", "q"), make,
                     "key long, vec_id long, label long, q array<int>, cell int, angle double, length double")


def _walk(k: int, same: bool, centres: np.ndarray):
    """For each ask of each anchor the ``k`` best candidates of a chunk: of the anchor's label or of others, with scores in the ask's range.

    Candidates are sorted once by the greatest inner product that they can have with an anchor of
    length 1 in the cluster: their length times the cosine of their angle to its centre less its widest
    angle. Each anchor reads the list until that bound, times its own length, lies strictly below
    every k-th score that it has found or been told of.
    """
    kind = pa.schema([("anchor", pa.int64()), ("ask", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    norms = np.sqrt((centres * centres).sum(axis=1))
    unit = centres / norms[:, None]

    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        if not candidates.num_rows or not anchors.num_rows:
            return kind.empty_table()
        candidates, anchors = candidates.combine_chunks(), anchors.combine_chunks()
        x, a = matrix(candidates["q"].combine_chunks()), matrix(anchors["q"].combine_chunks())
        centre = unit[anchors["cluster"][0].as_py()]
        length, angle = _angles(x, centre)
        own_length, own_angle = _angles(a, centre)
        bound = length * (np.cos(np.maximum(0.0, angle - own_angle.max())) + SLACK)
        order = np.argsort(-bound, kind="stable")
        x, bound = x[order], bound[order]
        label, vec_id, key = (candidates[c].to_numpy()[order] for c in ("label", "vec_id", "key"))
        exact = np.abs(x).max() * np.abs(a).max() * x.shape[1] < 1 << 53
        if not exact:
            x, a = x.astype(np.int64), a.astype(np.int64)
        asks = [[[ask["id"], ask["low"], ask["high"], np.empty(0, np.int64), np.empty(0, np.int64)] for ask in each] for each in anchors["asks"].to_pylist()]
        own_label, own_key = anchors["label"].to_numpy(), anchors["key"].to_numpy()
        need = np.array([min((ask[1] for ask in each), default=_MOST) for each in asks], np.float64)
        for at in range(0, len(x), STRIDE):
            active = np.flatnonzero(bound[at] * own_length >= need)
            if not len(active):
                break
            part = slice(at, at + STRIDE)
            scores = (a[active] @ x[part].T).astype(np.int64)
            fits = (label[part] == own_label[active, None]) == same
            if same:
                fits &= key[part] != own_key[active, None]
            for i, row, fit in zip(active.tolist(), scores, fits):
                least = _MOST
                for ask in asks[i]:
                    some = np.flatnonzero(fit & (row >= ask[1]) & (row <= ask[2]))
                    if len(some):
                        # ``low`` rises to the k-th score found.
                        s, v = np.concatenate([ask[3], row[some]]), np.concatenate([ask[4], vec_id[part][some]])
                        best = np.lexsort((v, -s))[:k]
                        ask[3], ask[4] = s[best], v[best]
                        if len(best) == k:
                            ask[1] = int(ask[3][-1])
                    least = min(least, ask[1])
                need[i] = least
        found = [(own, ask) for own, each in zip(own_key.tolist(), asks) for ask in each if len(ask[3])]
        if not found:
            return kind.empty_table()
        columns = [np.repeat([own for own, _ in found], [len(ask[3]) for _, ask in found]), np.repeat([ask[0] for _, ask in found], [len(ask[3]) for _, ask in found]),
                   np.concatenate([ask[4] for _, ask in found]), np.concatenate([ask[3] for _, ask in found])]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=kind)

    return run


def _best(anchors: DataFrame, candidates: DataFrame, order: DataFrame, centres: np.ndarray, k: int, same: bool) -> DataFrame:
    """``(anchor, ask, rank, vec_id, score)``: the ``k`` best of ``candidates`` for every ask of ``anchors`` (``asks``: id, low, high).

    ``order`` has for each cluster the cells of candidates with a bound on all inner products between
    them (for anchors of length 1), and their place by it. The first cell is walked first; its k-th
    scores then tell which further ones each anchor needs.
    """
    ranked = Window.partitionBy("anchor", "ask").orderBy(F.desc("score"), "vec_id")
    best = None
    for head in (True, False):
        asked = anchors
        if best is not None:
            told = best.where(F.col("rank") == k).groupBy(F.col("anchor").alias("key")).agg(
                F.map_from_entries(F.collect_list(F.struct("ask", "score"))).alias("told"))
            asked = anchors.join(told, "key", "left").withColumn("asks", F.transform("asks", lambda ask: F.struct(
                ask.id.alias("id"), F.coalesce(F.element_at("told", ask.id), ask.low).alias("low"), ask.high.alias("high")))).drop("told")
        least = F.array_min(F.transform("asks", lambda ask: ask.low)).cast("double")
        visits = asked.join(order.where((F.col("place") == 1) == head), "cluster").where(F.col("bound") * F.col("length") >= least)
        visits = written(visits.select("cluster", "group", "cell", "key", "label", "q", "asks"), "visits")
        met = visits.select("cluster", "group", "cell").distinct()
        chunks = candidates.groupBy("cell").agg((F.max("chunk") + 1).alias("chunks"))
        met = written(met.join(chunks, "cell").select("cluster", "group", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")), "met")
        keys = ("cluster", "group", "cell", "chunk")
        rows = candidates.join(met, ["cell", "chunk"]).select(*keys, "key", "vec_id", "label", "q")
        askers = visits.join(met, ["cluster", "group", "cell"]).select(*keys, "key", "label", "q", "asks")
        found = rows.groupBy(*keys).cogroup(askers.groupBy(*keys)).applyInArrow(_walk(k, same, centres), "anchor long, ask long, vec_id long, score long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = written(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "best")
        discard(visits, met)
    return best


def _percent(value: Column, share: int) -> Column:
    """The greatest whole number not above ``value * share / 100``."""
    product = value * share
    return F.call_function("div", product - F.pmod(product, F.lit(100)), F.lit(100))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = 30, high: int = 90, scale: int = 256, seed: int = 13, chunk_anchors: int = CHUNK_ANCHORS,
                   chunk_rows: int = CHUNK_ROWS, anchors_each: int = ANCHORS_EACH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``embeddings`` (``vec_id, embedding, label``).

    Components become floor(``scale`` x), scores are inner products of whole numbers. Where ``vec_id``
    is divisible by 7, the label becomes (label + 1) % 10. Anchors are rows whose ``vec_id`` is divisible
    by ``every``; an anchor's positives are its first ``positives`` other rows of its label by score
    (ties by ``vec_id``). For each positive of score p the first ``negatives`` rows of other labels
    with low p <= 100 score <= high p are returned.

    Anchors are clustered by direction (at most 256 centres, learned from 4 096 anchors), candidates
    placed in the cells of the same centres. Chunks of a cluster's anchors meet chunks of a cell's
    candidates, sorted once by an angular bound (:func:`_walk`); cells and rows that the bounds rule out
    are not read. Results are exact: a bound decides only where it lies strictly below what is
    wanted. A vector that a third of all rows repeat is dealt into chunks like any cell.

    Rows without a ``vec_id``, label or vector, with a component null, not finite or beyond 2 ** 24 once
    scaled, or with a vector that is empty or of another length than most, take no part. Rows that repeat id, label and
    components are one; rows that share an id otherwise are rows of their own. An anchor without
    positives, or a positive without negatives in range, has no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = written(_prepared(vectors, scale), "rows")
    is_anchor = F.col("vec_id") % every == 0
    total = rows.where(is_anchor).count()
    if not total:
        return nothing
    centres = _centres(rows.where(is_anchor), min(CLUSTERS, math.ceil(total / anchors_each)), seed)
    placed = written(_placed(rows, centres), "placed")
    cells = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max("angle").alias("wide"), F.min("length").alias("least"), F.max("length").alias("most"),
        F.max(F.when(is_anchor, F.col("angle"))).alias("reach")).collect()
    split = lambda size, of: F.pmod(F.xxhash64("key"), F.element_at(F.create_map(*(F.lit(x) for c in cells for x in (c.cell, max(1, math.ceil(c[of] / size))))), F.col("cell"))).cast("int")
    candidates = written(placed.select("cell", split(chunk_rows, "n").alias("chunk"), "key", "vec_id", "label", "q"), "candidates")
    anchors = written(placed.where(is_anchor).select(
        F.col("cell").alias("cluster"), split(chunk_anchors, "anchors").alias("group"), "key", "vec_id", "label", "q", "length"), "anchors")
    unit = centres / np.sqrt((centres * centres).sum(axis=1, keepdims=True))
    order = []
    for c in cells:
        if c.anchors:
            bounds = []
            for other in cells:
                between = math.acos(max(-1.0, min(1.0, float(unit[c.cell] @ unit[other.cell])))) if other is not c else 0.0
                cosine = math.cos(max(0.0, between - c.reach - other.wide)) + SLACK
                bounds.append((-(cosine * (other.most if cosine > 0 else other.least)), other is not c, other.cell))
            order += [(c.cell, cell, -bound, place) for place, (bound, _, cell) in enumerate(sorted(bounds, key=lambda b: (b[1], b[0])), 1)]
    order = spark.createDataFrame(order, "cluster int, cell int, bound double, place int")

    ask = lambda number, least, most: F.struct(number.cast("long").alias("id"), least.cast("long").alias("low"), most.cast("long").alias("high"))
    first = anchors.withColumn("asks", F.array(ask(F.lit(0), F.lit(_LEAST), F.lit(_MOST))))
    near = _best(first, candidates, order, centres, positives, True)
    # Positives of one score ask alike.
    bands = near.select("anchor", "score").distinct().select("anchor", ask(F.col("score"), -_percent(-F.col("score"), low), _percent(F.col("score"), high)).alias("ask"))
    bands = bands.where("ask.low <= ask.high").groupBy(F.col("anchor").alias("key")).agg(F.collect_list("ask").alias("asks"))
    second = written(anchors.join(bands, "key"), "asking")
    far = _best(second, candidates, order, centres, negatives, False)
    pairs = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    far = far.select("anchor", F.col("ask").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return pairs.join(far, ["anchor", "positive_score"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
