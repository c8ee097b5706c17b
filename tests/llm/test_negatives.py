"""Hard negatives against all pairs, over one chunk and over many, with odd rows among them."""

from collections import Counter

import numpy as np
import pytest

from signpost.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key long, cell int, cluster int, asks string, q int, score long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "a", 4, 5) for r in rows], SCHEMA)


def brute(rows, every, positives, k):
    good = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))
            for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    size = Counter(len(v) for *_, v in good).most_common(1)[0][0] if good else 0
    good = [g for g in good if len(g[2]) == size]
    q = np.array([g[2] for g in good], np.int64).reshape(len(good), size)
    out = Counter()
    for a, (anchor, label, own) in enumerate(good):
        if anchor % every:
            continue
        scores = (q @ np.array(own, np.int64)).tolist()
        ranked = sorted((-s, g[0], g[1] == label) for n, (s, g) in enumerate(zip(scores, good)) if n != a)
        for p, positive, _ in [r for r in ranked if r[2]][:positives]:
            near = [(-s, i) for s, i, same in ranked if not same and -30 * p <= -100 * s <= -90 * p][:k]
            out.update((anchor, positive, n, i, -p, s) for n, (s, i) in enumerate(near, 1))
    return out


def clustered(n, dims, seed, families=8, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((families, dims))
    x = centres[rng.integers(0, families, n)] + spread * rng.standard_normal((n, dims))
    return [(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x.astype(np.float32) * np.float32(0.2), rng.integers(0, 10, n)))]


@pytest.fixture(scope="module")
def rows():
    out = clustered(900, 12, 3)
    out += [(2000 + i, out[100][1], i % 3) for i in range(200)]  # copies, many of them anchors
    out += [(3000, None, 1), (3001, [0.0] * 12, 4), (3100, [0.0] * 12, 4), (3002, [float("nan")] + [1.0] * 11, 1), (3003, [float("inf")] + [1.0] * 11, 1),
            (3004, [None] + [1.0] * 11, 1), (3200, out[5][1], None), (3005, [], 2), (3300, [1.0] * 5, 2), (None, out[6][1], 3), (None, None, None),
            (100, out[100][1], out[100][2]), (100, out[7][1], 6), (3400, [-x for x in out[8][1]], 1), (3007, out[9][1], -4)]
    return out


@pytest.mark.parametrize("how", [{}, {"chunk_anchors": 3, "chunk_rows": 50, "anchors_each": 2}, {"anchors_each": 1, "chunk_rows": 7}])
def test_negatives_equal_all_pairs(spark, rows, how, monkeypatch):
    monkeypatch.setattr(negatives, "STRIDE", 16 if how else 512)
    got = negatives.hard_negatives(frame(spark, rows), every=50, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, 50, 5, 10)
    assert len(want) > 500 and Counter(map(tuple, got.collect())) == want


def test_walks_end_before_the_list(monkeypatch):
    """Tight clusters: an anchor's list ends after the candidates of its own direction."""
    import pyarrow as pa

    monkeypatch.setattr(negatives, "STRIDE", 16)
    rows = [(i, [int(256 * x) for x in v], label) for i, v, label in clustered(2_000, 12, 9, families=40, spread=0.02)]
    centre = np.array(rows[0][1], float)
    near = [r for r in rows if np.dot(r[1], centre) > 0.98 * np.linalg.norm(r[1]) * np.linalg.norm(centre)][:20]
    table = lambda some, **more: pa.table({"key": [r[0] for r in some], "vec_id": [r[0] for r in some], "label": [r[2] for r in some], "q": pa.array([r[1] for r in some], pa.list_(pa.int32())), **more})
    seen = []
    monkeypatch.setattr(negatives.np, "flatnonzero", lambda x, real=np.flatnonzero: seen.append(x) or real(x))
    asks = [[{"id": 0, "low": negatives._LEAST, "high": negatives._MOST}]] * len(near)
    out = negatives._walk(5, False, centre[None, :])(table(rows), table(near, cluster=[0] * len(near), asks=asks))
    assert out.num_rows == 5 * len(near)
    strides = sum(1 for x in seen if len(x) == len(near))
    assert strides < 2_000 / 16 / 4


def test_large_components_are_scored_in_whole_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-60_000, 60_000, 6)).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    assert Counter(map(tuple, negatives.hard_negatives(frame(spark, rows), every=10).collect())) == brute(rows, 10, 5, 10)


def test_empty_tables(spark):
    for few in ([], [(100, None, 1)], [(101, [1.0], 1)], [(100, [1.0], 1)]):
        assert negatives.hard_negatives(frame(spark, few)).collect() == []
