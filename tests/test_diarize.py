"""Clusters of frames against brute force, and recordings that don't change each other."""

import time
import tracemalloc
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import diarize, timeline, voices


def same(a, b):
    """Equal up to renaming."""
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def slow_ward(x, k):
    """Every pair of clusters at every step."""
    clusters = [(1.0, p, [i]) for i, p in enumerate(x)]
    while len(clusters) > k:
        _, i, j = min((a[0] * b[0] / (a[0] + b[0]) * ((a[1] - b[1]) ** 2).sum(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        a, b = clusters[i], clusters[j]
        clusters[i] = (a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2] + b[2])
        del clusters[j]
    out = np.zeros(len(x), int)
    for c, (_, _, rows) in enumerate(clusters):
        out[rows] = c
    return out.tolist()


def three_voices(n=60, width=6, seed=0):
    truth = np.repeat(np.arange(3), n)
    return np.random.default_rng(seed).normal(0, 0.3, (3 * n, width)) + 8 * np.eye(width)[truth], truth.tolist()


@pytest.mark.parametrize("n,k", [(40, 3), (60, 5), (30, 1), (30, 29), (4, 6), (1, 1)])
def test_ward_equals_all_pairs(n, k):
    x = np.random.default_rng(n).normal(size=(n, 4))
    assert same(voices.ward(np.ones(n), x, k).tolist(), slow_ward(x, k))


def test_ward_of_numbers_and_means():
    """Merging equal points first changes nothing."""
    x = np.random.default_rng(3).normal(size=(12, 3))
    n = np.arange(1, 13)
    whole = slow_ward(np.repeat(x, n, axis=0), 4)
    assert same(np.repeat(voices.ward(n, x, 4), n).tolist(), whole)


def test_neighbours_are_exact_in_one_bucket_and_nearly_in_several(monkeypatch):
    dice = np.random.default_rng(1)
    x = dice.normal(size=(900, 4)) @ dice.normal(size=(4, 30))
    exact = np.argsort(voices.squared(x, x) + np.where(np.eye(900), np.inf, 0), axis=1)[:, :12]
    assert [set(r) for r in voices.neighbours(x, 12)[0]] == [set(r) for r in exact]
    monkeypatch.setattr(voices, "LEAF", 100)
    near, far = voices.neighbours(x, 12)
    assert np.mean([len(set(a) & set(b)) / 12 for a, b in zip(near, exact)]) > 0.97
    assert np.allclose(far, [voices.squared(x[[i]], x[r])[0] for i, r in enumerate(near)]) and not (near == np.arange(900)[:, None]).any()
    assert (voices.neighbours(x[:3], 5)[0] >= 0).sum() == 6


def test_vectors_are_those_of_the_whole_matrix():
    x = np.random.default_rng(2).normal(size=(200, 5))
    g = voices.Graph(voices.neighbours(x, 8)[0])
    w, ends = np.zeros((200, 200)), [*g.starts[1:], len(g.col)]
    for i in range(200):
        w[i, g.col[g.starts[i] : ends[i]]] = g.weight[g.starts[i] : ends[i]]
    d = w.sum(1)
    assert (w == w.T).all() and np.allclose(d, g.degree)
    scaled = w / np.sqrt(np.outer(d, d))
    mine = g.vectors(4) * np.sqrt(d)[:, None]
    assert np.allclose(mine.T @ scaled @ mine, np.diag(np.linalg.eigvalsh(scaled)[::-1][:4]), atol=1e-6)


def test_vectors_hold_no_number_for_each_link_and_column():
    g = voices.Graph(np.random.default_rng(4).integers(0, 4000, (4000, 29)))
    tracemalloc.start()
    g.vectors(3, cycles=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * g.vectors(3, cycles=1).shape[0] * 60 * 8 < len(g.col) * 60 * 8


def test_a_portion_holds_few_numbers_for_each_vector_and_link(monkeypatch):
    """No differences of many rows from all their candidates, and the vectors no longer than until their neighbours are known."""
    n, truth, graph, held = 6000, np.arange(6000) // 5 % 3, voices.Graph, []

    def peak(run):
        tracemalloc.start()
        out = run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    def drawn():
        x = np.random.default_rng(5).normal(size=(n, 64))
        x += 4 * (np.arange(64)[None] % 3 == truth[:, None])
        held.append(weakref.ref(x))
        return x

    near, most = peak(lambda: voices.neighbours(drawn(), 29)[0])
    assert most < 40_000_000
    g, most = peak(lambda: graph(near))
    assert most < 50 * len(g.col)
    assert peak(lambda: g.vectors(3))[1] < 2000 * n
    monkeypatch.setattr(voices, "Graph", lambda near: held.append(held[-1]() is None) or graph(near))
    labels = voices.spectral(drawn(), 3)
    assert held[-1] is True and same(labels.tolist(), truth.tolist())


def test_spectral_tells_voices_and_rings_apart():
    x, truth = three_voices()
    assert same(voices.spectral(x, 3).tolist(), truth)
    t = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    ring = np.c_[np.cos(t), np.sin(t)]
    x = np.concatenate([ring, 3 * ring]) + np.random.default_rng(0).normal(0, 0.04, (600, 2))
    assert same(voices.spectral(x, 2).tolist(), [0] * 300 + [1] * 300)
    assert not same(voices.kmeans(x, 2).tolist(), [0] * 300 + [1] * 300)


@pytest.mark.parametrize("x", [np.zeros((0, 3)), np.zeros((1, 3)), np.zeros((2, 3)), np.zeros((40, 3)), np.arange(12.0).reshape(4, 3)])
def test_few_or_equal_rows(x):
    for f in (voices.spectral, voices.kmeans, lambda x, k: voices.ward(np.ones(len(x)), x, k)):
        if len(x):
            assert len(f(x, 3)) == len(x)
    assert voices.speakers(x) == 2


def plain_kmeans(x, k, weight, starts, most=100):
    """All distances anew for each seed, sums row by row."""
    dice, best, least = np.random.default_rng(voices.SEED), None, np.inf
    for _ in range(starts):
        middles = x[[dice.choice(len(x), p=weight / weight.sum())]]
        for _ in range(k - 1):
            d = ((x[:, None] - middles[None]) ** 2).sum(2).min(1) * weight
            middles = np.concatenate([middles, x[[dice.choice(len(x), p=d / d.sum())]]])
        labels = None
        for _ in range(most):
            new = ((x[:, None] - middles[None]) ** 2).sum(2).argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            for c in set(labels.tolist()):
                middles[c] = np.average(x[labels == c], axis=0, weights=weight[labels == c])
        cost = (((x[:, None] - middles[None]) ** 2).sum(2).min(1) * weight).sum()
        if cost < least - 1e-12:
            best, least = labels, cost
    return best


def test_kmeans_equals_the_plain_form_with_work_in_proportion_to_k(monkeypatch):
    x, weight = np.random.default_rng(5).normal(size=(700, 6)), np.random.default_rng(6).integers(1, 5, 700)
    for w in (np.ones(700), weight.astype(float)):
        assert voices.kmeans(x, 20, w, starts=3).tolist() == plain_kmeans(x, 20, w, 3).tolist()
    pairs, squared = [], voices.squared
    monkeypatch.setattr(voices, "squared", lambda a, b: pairs.append(len(a) * len(b)) or squared(a, b))
    voices.kmeans(x, 64, starts=1, most=1)
    assert sum(pairs) <= 3 * 64 * 700  # seeds, one round and the cost: each seed's distances are looked for once


def test_silhouette():
    x, truth = np.array([[0.0], [1.0], [10.0], [14.0], [50.0]]), np.array([0, 0, 1, 1, 2])
    want = [(12 - 1) / 12, (11 - 1) / 11, (9.5 - 4) / 9.5, (13.5 - 4) / 13.5, 0]
    assert voices.silhouette(x, truth) == pytest.approx(np.mean(want))
    assert voices.silhouette(x, np.zeros(5, int)) == -1


def test_number_of_speakers():
    assert voices.decide({2: 0.5, 3: 0.3, 4: 0.2}, {2: 10, 3: 20, 4: 30}) == 2
    assert voices.decide({2: 0.5, 3: 0.49, 4: 0.1}, {2: 20, 3: 10, 4: 30}) == 3
    assert voices.decide({2: 0.5, 3: 0.5, 4: 0.5}, {2: 30, 3: 20, 4: 10}) == 4
    assert voices.decide({2: 0.2}, {2: 1}) == 2 and voices.decide({2: 0.3, 3: 0.28}, {2: 1, 3: 2}) == 3
    for k in (2, 3, 4):
        x = np.random.default_rng(k).normal(0, 0.3, (400, 8)) + 3 * np.eye(8)[np.arange(400) % k]
        assert voices.speakers(x) == voices.speakers_fast(x) == k


def frames(spark, recordings):
    """Rows of (recording, voices in the order of their turns of 20 frames)."""
    rows = []
    for name, turns in recordings.items():
        dice = np.random.default_rng(abs(hash(str(name))) % 1000 if not isinstance(name, int) else name)
        for i in range(20 * len(turns)):
            v = dice.normal(0, 0.2, 8) + 6 * np.eye(8)[turns[i // 20]]
            rows.append((name, i, v.tolist(), 0.01 if i % 5 == 2 else 1 + (i % 20) / 100, 20 * len(turns) * 512 / 16000))
    return spark.createDataFrame(rows, "path int, i long, features array<double>, rms double, duration double").repartition(3)


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["path"] is not None, r["path"], r["idx"])):
        out.setdefault(r["path"], []).append((r["start"], r["end"], r["speaker"]))
    return out


@pytest.mark.parametrize("method", ["spectral", "hierarchical", "kmeans"])
def test_three_voices_of_every_recording(spark, method):
    given = {1: [0, 1, 2] * 3, 2: [5, 3, 4] * 3, None: [0, 0, 7, 6] * 2}
    found = told(diarize.diarize(frames(spark, given), "path", speakers=3, method=method))
    for name, turns in given.items():
        order = list(dict.fromkeys(turns))
        ends, speakers = [x[1] for x in found[name]], [x[2] for x in found[name]]
        runs = [k for k in range(len(turns)) if not k or turns[k] != turns[k - 1]]
        assert speakers == [f"SPEAKER_0{order.index(turns[k])}" for k in runs]
        assert [x[0] for x in found[name]] == pytest.approx([0.64 * k for k in runs]) and ends[-1] == pytest.approx(0.64 * len(turns))


def test_others_change_nothing(spark):
    """A recording alone, and with one that is louder, longer and scaled otherwise; short and empty ones have no segments."""
    one = frames(spark, {1: [0, 1] * 4})
    other = frames(spark, {2: [2, 3, 4] * 6}).withColumn("features", F.transform("features", lambda x: x * 1000)).withColumn("rms", F.col("rms") * 50)
    short = frames(spark, {3: [0]}).where("i < 11")
    alone = told(diarize.diarize(one, "path"))
    both = told(diarize.diarize(one.union(other).union(short), "path"))
    assert set(both) == {1, 2} and both[1] == alone[1] and len({x[2] for x in both[2]}) == 3
    assert diarize.diarize(one.where("false"), "path").collect() == []


@pytest.mark.parametrize("method", ["spectral", "hierarchical", "kmeans"])
def test_portions_are_merged(spark, monkeypatch, method):
    """Many small portions and three levels of merging give what one portion gives."""
    x, truth = three_voices(120)
    points = spark.createDataFrame([(1, i, v, "x") for i, v in enumerate(x.tolist())] + [(2, i, v, "y") for i, v in enumerate(x[::-1][:50].tolist())], "path int, i long, scaled array<double>, label string").drop("label")
    monkeypatch.setitem(diarize.PORTION, method, 40)
    monkeypatch.setattr(diarize, "TOGETHER", 2)
    found = {(r["path"], r["i"]): r["label"] for r in diarize.clustered(points, "path", 3, method).collect()}
    assert [found[1, i] for i in range(360)] == truth and {found[2, i] for i in range(50)} <= {0, 1, 2}


def test_hierarchical_equals_all_pairs_in_spark(spark):
    x = np.random.default_rng(8).normal(size=(150, 5))
    points = spark.createDataFrame([(i % 2, i, v) for i, v in enumerate(x.tolist())], "path int, i long, scaled array<double>")
    found = {r["i"]: r["label"] for r in diarize.clustered(points, "path", 4, "hierarchical").collect()}
    for p in (0, 1):
        assert same([found[i] for i in range(p, 150, 2)], slow_ward(x[p::2], 4))


def test_short_segments_of_many_are_merged_in_one_pass(spark):
    """As the fold over an array has it, with missing values too; a recording of very many segments takes no longer for each."""
    dice = np.random.default_rng(6)
    rows = [(k % 7 or None, i, *((None, None, None) if dice.random() < 0.02 else (float(i), i + float(dice.choice([0.1, 0.4, 2.0])), "abc"[dice.integers(3)]))) for i, k in enumerate(dice.integers(0, 7, 900).tolist())]
    given = spark.createDataFrame(rows, "m int, idx int, start double, end double, speaker string")
    array = given.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("idx", "start", "end", "speaker"))).alias("s"))
    want = array.select("m", F.posexplode(timeline.merge_short(F.col("s"), 0.3)).alias("idx", "x")).select("m", "idx", "x.start", "x.end", "x.speaker")
    every = lambda df: sorted(map(repr, df.collect()))
    assert every(timeline.merged_short(given, "m", 0.3)) == every(want)
    many = spark.range(200_000).select(F.lit(1).alias("m"), F.col("id").cast("int").alias("idx"), F.col("id").cast("double").alias("start"), (F.col("id") + 1).cast("double").alias("end"), (F.col("id") % 3).cast("string").alias("speaker"))
    began = time.time()
    assert timeline.merged_short(many, "m", 0.3).count() == 200_000 and time.time() - began < 60


def test_no_window_over_all_that_follows(spark):
    """Such a frame takes a step for each pair of a recording's frames."""
    rows = spark.range(150_000).select(F.lit(1).alias("m"), F.col("id").alias("i"), F.when(F.col("id") % 5 == 0, F.col("id") % 3).alias("l"))
    filled = timeline.fill_nearest(rows, "m", "i", "l", F.col("l").isNotNull())
    assert "unboundedfollowing" not in filled._jdf.queryExecution().optimizedPlan().toString().lower()
    began = time.time()
    far = filled.where("l != floor((i + 2) / 5) * 5 % 3 and i < 149995").count()
    assert far == 0 and time.time() - began < 60
