import math
import time

import numpy as np

from deeptime.operators import layers as L


def star(k, n=48):
    radius = lambda i: 1 + k % 5 + (0 if i % 2 == 0 else 0.004 * (1 + k % 7))
    p = [(radius(i) * math.cos(i * 2 * math.pi / n), radius(i) * math.sin(i * 2 * math.pi / n)) for i in range(n)]
    return np.array(p + p[:1])


def test_rings_together_are_as_one_by_one():
    rng = np.random.default_rng(5)
    rings = [star(k) for k in range(20)] + [np.zeros((0, 2)), np.zeros((1, 2)), np.ones((5, 2)), np.array([[0, 0], [1, 0], [0, 0]]), np.array([[0, 0], [np.nan, 1], [1, 1], [0, 0]])]
    for n in rng.integers(1, 40, 400):
        p = rng.integers(-4, 5, (n, 2)) * rng.choice([0.01, 0.5, 60])  # many repeated points, lines, pinches and crossings
        rings.append(np.vstack((p, p[:1])) if rng.random() < 0.8 else p)
    rings.append(np.cumsum(rng.normal(0, 0.01, (700, 2)), 0))
    outer = rng.random(len(rings)) < 0.7
    xy, ends = np.concatenate(rings), np.concatenate(([0], np.cumsum([len(r) for r in rings])))
    for t in (0.0005, 0.01, 0.2, 1.0):
        got = L.simplified_all(xy, ends, t, outer)
        for r, e, c in zip(rings, outer, got):
            want = L.simplified(r, t, bool(e))
            assert (c is None) == (want is None) and (want is None or np.array_equal(c, want))


def test_many_small_rings_are_not_simplified_one_by_one(monkeypatch):
    rings = [star(k) for k in range(2000)]
    xy, ends = np.concatenate(rings), np.arange(len(rings) + 1) * 49
    monkeypatch.setattr(L, "_kept", None)
    began = time.time()
    assert all(c is not None for c in L.simplified_all(xy, ends, 0.01, np.ones(len(rings), bool)))
    assert time.time() - began < 20


def test_a_ladder_reads_its_rings_once_for_all_tolerances(spark):
    """One pass over the rings; its rows are those of ``simplify`` tolerance by tolerance."""
    square = [(0.0, 0.0), (1.0, 0.02), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    rings = spark.createDataFrame([(k, k % 2, [(x * (1 + k), y * (1 + k)) for x, y in square]) for k in range(6)], "ring_id long, slice long, ring array<struct<lon:double,lat:double>>")
    steps = [0.001, 0.05, 5.0]
    got = L.simplify_steps(rings, steps, "slice")
    want = {(r.ring_id, k): (r.ring, r.dropped) for k, t in enumerate(steps) for r in L.simplify(rings, t).collect()}
    assert {(r.ring_id, r.step): (r.ring, r.dropped) for r in got.collect()} == want
    sizes = L.ladder_sizes(rings, steps)
    assert sizes.count() == 18 and sizes._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
