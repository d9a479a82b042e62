import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import sort_means as sm


def plain(rows, k, rounds, dims, scale=64, seed=1):
    """Python integers, every distance of every vector."""
    kept = [(i, [math.floor(scale * float(np.float32(v))) for v in e]) for i, e in rows if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]
    lot = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    centroids = [x for _, x in lot[:k]]
    apart = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c))
    for turn in range(rounds + 1):
        found = [min((apart(x, c), n) for n, c in enumerate(centroids)) for _, x in kept]
        if turn < rounds:
            for n in {n for _, n in found}:
                own = [x for (_, x), (_, m) in zip(kept, found) if m == n]
                centroids[n] = [sum(v) // len(own) for v in zip(*own)]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, found)), key=repr), centroids


SMALL = st.integers(-3, 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(SMALL, SMALL, st.integers(0, 3)), min_size=1, max_size=30), st.lists(st.tuples(SMALL, SMALL), min_size=4, max_size=4))
def test_scan_equals_all_distances_with_ties(points, centroids):
    x, before, c = np.array([p[:2] for p in points]), np.array([p[2] for p in points]), np.array(centroids)
    cluster, distance, looked = sm.assign(x, before, c)
    every = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert (distance == every.min(1)).all() and (cluster == every.argmin(1)).all()
    assert len(points) <= looked <= every.size


def test_scan_ends_early_on_separate_clusters():
    dice = np.random.default_rng(1)
    c = dice.integers(-1000, 1000, (16, 8))
    before = dice.integers(0, 16, 2000)
    assert sm.assign(c[before] + dice.integers(-3, 4, (2000, 8)), before, c)[2] == 2000


def rows(n, dims=6, seed=3):
    dice = random.Random(seed)
    middles = [[dice.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [float(np.float32(v + dice.gauss(0, 0.2))) for v in dice.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("portion", [1 << 14, 7])
def test_equals_brute_force(spark, monkeypatch, portion):
    monkeypatch.setattr(sm, "PORTION", portion)
    given = [*rows(200), *[(7, rows(200)[7][1])] * 60, (None, rows(3, seed=9)[2][1]), (300, None), (301, []), (302, [0.5] * 5), (303, [0.5] * 7), (304, [None] + [0.5] * 5), (305, [math.nan] * 6), (306, [math.inf] * 6), (307, [-math.inf] + [0.0] * 5), (308, [-0.01] * 6)]
    df = spark.createDataFrame([(*r, 1, "c") for r in given], "vec_id long, embedding array<float>, cluster int, x string").repartition(3)
    found, centroids = sm.sort_means(df, k=4, rounds=3, dims=6)
    want, middles = plain(given, 4, 3, 6)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=repr) == want
    told = {r["cluster"]: r for r in centroids.collect()}
    assert [told[c]["centroid"] for c in range(4)] == middles
    assert sum(r["n"] for r in told.values()) == len(want) and sum(r["inertia"] for r in told.values()) == sum(d for _, _, d in want)


def test_fewer_vectors_than_centroids_and_none(spark):
    given = [(1, [0.5, 0.5]), (2, [0.25, 1.0]), (2, [0.25, 1.0])]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    found, centroids = sm.sort_means(df, k=16, dims=2)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == plain(given, 16, 3, 2)[0]
    assert centroids.count() == 3
    found, centroids = sm.sort_means(df.where("vec_id > 5"), dims=2)
    assert found.columns == ["vec_id", "x", "cluster", "distance"] and found.count() == 0 and centroids.count() == 0


def test_an_empty_centroid_stays(spark):
    """Equal first centroids: the larger number gets nothing and does not move."""
    given = [(i, [1.0, 1.0] if i < 9 else [float(i), 0.0]) for i in range(12)]
    found, centroids = sm.sort_means(spark.createDataFrame(given, "vec_id long, embedding array<double>"), k=6, dims=2)
    want, middles = plain(given, 6, 3, 2)
    assert [r["centroid"] for r in centroids.orderBy("cluster").collect()] == middles
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=repr) == want


def test_sums_beyond_a_portion_are_exact_and_too_large_ones_an_error(spark):
    given = [(i, [float((-1) ** i * 3e6)]) for i in range(9)]
    found, centroids = sm.sort_means(spark.createDataFrame(given, "vec_id long, embedding array<double>"), k=1, dims=1)
    want, middles = plain(given, 1, 3, 1)
    assert [r["centroid"] for r in centroids.collect()] == middles and centroids.first()["inertia"] == sum(d for _, _, d in want)
    with pytest.raises(Exception, match="64-bit"):
        sm.sort_means(spark.createDataFrame([(1, [1e12])], "vec_id long, embedding array<double>"), k=1, dims=1)
