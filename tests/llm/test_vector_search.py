import math

import numpy as np
import pytest

from wordloom.llm import vector_search as V


def brute(rows, top, every=20):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(64 * float(x)) for x in v]
            best[i] = min(best.get(i, v), v)
    out = []
    for i, q in best.items():
        if i % every == 0:
            dot = lambda v: min(max(sum(a * b for a, b in zip(q, v)), -2**63), 2**63 - 1)  # noqa: B023, E731
            scored = sorted((-dot(v), j) for j, v in best.items() if j != i and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:top], 1)]
    return sorted(out)


def rows(n, width=64, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    v = (centres[rng.integers(5, size=n)] + rng.normal(size=(n, width)) * 0.3) / 8
    v[n // 2: n // 2 + n // 4] = v[3]           # a large group of equal vectors
    return [(i, [float(np.float32(x)) for x in v[i]]) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, 2) for r in data], "vec_id long, embedding array<float>, rank int, score int").repartition(5)


@pytest.mark.parametrize("blocks", [False, True])
def test_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(V, "QUERY_BLOCK", 10)
        monkeypatch.setattr(V, "CANDIDATE_BLOCK", 20)
        monkeypatch.setattr(V, "CHUNK", 16)
    data = rows(700)
    assert sorted(map(tuple, V.nearest(frame(spark, data)).collect())) == brute(data, 20)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [(i, [i / 7, -1.0, 0.5]) for i in range(0, 60, 4)] + [(1, None), (100, [nan, 1.0, 1.0]), (3, [inf, 0.0, 0.0]), (5, [None, 1.0, 2.0]), (None, [1.0, 1.0, 1.0]),
            (20, [0.1, 0.2, 0.3]), (20, [0.1, 0.2, 0.3]), (-40, [1.0, 2.0, 3.0]), (7, []), (200, []), (9, [1.0]), (11, [1e30, -1e30, 1e30]), (13, [-1e30, 1e30, 1e30]), (400, [5.0])]
    got = sorted(map(tuple, V.nearest(frame(spark, data)).collect()))
    want = brute([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in data], 20)
    assert got == want
    assert V.nearest(frame(spark, [])).count() == 0
    assert V.nearest(frame(spark, [(20, [1.0])])).count() == 0


def test_bounds_hold_and_prune(monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 64)
    walk = np.cumsum(np.random.default_rng(3).normal(size=(3000, 64)), axis=1)
    v = np.floor(64 * walk / np.linalg.norm(walk, axis=1, keepdims=True))
    for s in V.resolutions(64):
        f = V.segment_features(v, s)
        assert (V.most_scores(f[:50], f) >= v[:50] @ v.T - 1e-6).all()
    ids = np.arange(3000)
    found, scored = V.search_block(ids[:3000:20], v[:3000:20], ids, v, 20)
    assert scored < 0.5 * 150 * 3000        # most pairs are never scored
