"""The embedding operators against brute force, with odd rows among them."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from signpost.llm import clusters, neighbours
from signpost.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int, key long, tree int, rows long, chunk int, a long, least long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6, 7) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((600, 24)).astype(np.float32)
    for g in range(12):  # families of near copies, around a cosine of 0.9
        base = vectors[g * 40]
        for c in range(1, 12):
            vectors[g * 40 + c] = base + rng.standard_normal(24).astype(np.float32) * np.float32(0.05 * c)
    vectors[500] = vectors[3] * 4  # same direction, other length
    out = [(i, v.tolist()) for i, v in enumerate(vectors)]
    out += [(700 + i, vectors[60].tolist()) for i in range(30)]  # copies
    out += [(800, None), (801, [0.0] * 24), (802, [float("nan")] + [1.0] * 23), (803, [float("inf")] + [1.0] * 23),
            (804, [None] + [1.0] * 23), (805, []), (None, vectors[5].tolist()), (None, None), (60, vectors[60].tolist()), (61, vectors[90].tolist())]
    return out


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_duplicates_equal_all_pairs(spark, rows):
    got = [r.asDict() for r in clusters.near_duplicates(frame(spark, rows), leaf_rows=64, sample_rows=300).collect()]
    assert len(got) == len(rows) and set(got[0]) == {"vec_id", "n_links", "component_id", "kept"}
    good = [(i, np.array(v, np.float64)) for i, v in rows if usable(v)]
    x = np.array([v for _, v in good])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = x @ x.T >= 0.9
    links = near.sum(axis=1) - 1
    parent = np.arange(len(x))
    while True:
        least = np.array([parent[near[k]].min() for k in range(len(x))])
        if (least == parent).all():
            break
        parent = least
    smallest = {p: min((i for k, (i, _) in enumerate(good) if parent[k] == p and i is not None), default=None) for p in set(parent)}
    want = Counter((i, int(links[k]), smallest[parent[k]], i is not None and i == smallest[parent[k]]) for k, (i, _) in enumerate(good))
    want += Counter((i, 0, i, i is not None) for i, v in rows if not usable(v))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want


def test_nearest_reach_their_recall(spark, rows):
    got = defaultdict(list)
    for r in neighbours.nearest_to_every(frame(spark, rows), k=10, group_rows=64).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {(i, tuple(np.float32(v).astype(float))) for i, v in rows if usable(v) and i is not None}
    queries = sorted({i for i, _ in good if i % 20 == 0})
    assert sorted(got) == queries
    hits = wanted = 0
    for q in queries:
        own = [np.array(v) for i, v in good if i == q]
        scores = sorted({(-float((np.array(v) * o).sum()), i) for i, v in good if i != q for o in own})[:10]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        by_id = defaultdict(set)
        for i, v in good:
            by_id[i].update(round(float((np.array(v) * o).sum()), 9) for o in own)
        assert all(round(s, 9) in by_id[i] and i != q for _, i, s in found)
        hits += len({i for _, i in scores} & {i for _, i, _ in found})
        wanted += len({i for _, i in scores})
    assert hits >= 0.95 * wanted


def test_few_candidates_are_all_returned(spark):
    few = [(i, [1.0, float(i)]) for i in range(4)]
    got = neighbours.nearest_to_every(frame(spark, few)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0)]


def test_empty_tables(spark):
    for few in ([], [(20, None)]):
        assert neighbours.nearest_to_every(frame(spark, few)).collect() == []
    assert clusters.near_duplicates(frame(spark, [])).collect() == []
    assert [tuple(r) for r in clusters.near_duplicates(frame(spark, [(20, None)])).collect()] == [(20, 0, 20, True)]


def test_forest_keeps_links_of_a_large_family_at_any_depth():
    """A third of all rows one family, whatever the depth: no link lost, copies of rows bounded."""
    rng = np.random.default_rng(1)
    n, d = 3_000, 64
    line = rng.standard_normal((1, d))
    family = line / np.linalg.norm(line) + 0.33 * rng.standard_normal((n // 3, d)) / np.sqrt(d)
    rows = np.concatenate([family, rng.standard_normal((n - n // 3, d))])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(rows @ rows.T >= 0.9, 1))
    assert len(i) > 100_000
    for depth in (3, 7, 10):
        found, copies = np.zeros(len(i), bool), 0
        for t in range(clusters.trees_for(depth)):
            tree = clusters.Tree(*clusters.Tree(t, depth, clusters.SPILL * np.sqrt(0.2 / d)).fitted(rows, n / 2 ** depth))
            row, leaf, _ = tree.leaves(rows)
            kinds, leaf = np.unique(leaf, return_inverse=True)
            inside = np.zeros((n, len(kinds)), np.float32)
            inside[row, leaf] = 1
            found |= (inside @ inside.T > 0)[i, j]
            copies += len(row)
        assert found.mean() >= 0.9999 and copies <= 50 * n


def test_trees_grow_with_depth():
    assert [clusters.trees_for(depth) for depth in (0, 1, 11, 30, 60)] == sorted(clusters.trees_for(depth) for depth in (0, 1, 11, 30, 60))
    assert clusters.trees_for(0) == 1 and clusters.trees_for(11) == 8 and clusters.trees_for(30) > 8


def test_components_of_chains_stars_and_pairs(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5001, 5000), (5000, 5001), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)} | {5000: 5000, 5001: 5000}
    assert got == want


def test_stop_level_follows_the_angle():
    levels = [neighbours.stop_level(c, 24, 0.05) for c in (-0.5, 0.0, 0.4, 0.9, 0.99, 1.0)]
    assert levels == sorted(levels) and levels[-1] == neighbours.BITS and levels[0] <= 2
