import itertools
import random
import re

import numpy as np

from colloquy.llm import ngram_join as nj


def brute(rows):
    def runs(t):
        w = re.findall(r"\w+", (t or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)}) - {()}

    texts = {t for _, t in rows if runs(t)}
    sets = {t: runs(t) for t in texts}
    links = {t: set() for t in texts}
    for a, b in itertools.combinations(texts, 2):
        c = len(sets[a] & sets[b])
        if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a].add(b), links[b].add(a)
    ids, same = {}, {}
    for i, t in rows:
        ids.setdefault(t, []).append(i)
        same[t] = same.get(t, 0) + 1
    out = []
    for i, t in rows:
        if t not in texts:
            out.append((i, i, 0, 1))
            continue
        seen, todo = {t}, [t]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        out.append((i, min((k for x in seen for k in ids[x] if k is not None), default=None), len(links[t]), same[t]))
    return sorted(out, key=str)


def found(spark, rows, schema="doc_id long, text string"):
    return sorted([tuple(r) for r in nj.similar(spark.createDataFrame(rows, schema)).select("doc_id", "class_id", "n_links", "n_same").collect()], key=str)


def corpus(dice, groups, size, changes):
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [dice.choice(words) for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(dice.randint(0, changes)):
                own[dice.randrange(len(own))] = dice.choice(words)
            rows.append((len(rows), " ".join(own)))
    return rows


def test_near_copies_and_edges(spark):
    rows = corpus(random.Random(1), 12, 5, 3)
    rows += [(900, None), (901, ""), (902, " ,. "), (903, "one two"), (904, "One, two!"), (905, "three"), (906, None), (7, rows[7][1]), (None, rows[9][1]), (None, "only here without id but with words"), (1, "another text with the id one again")]
    assert found(spark, rows) == brute(rows)


def test_a_large_group_falls_into_blocks(spark, monkeypatch):
    rows = corpus(random.Random(2), 1, 90, 2) + [(1000 + i, r[1]) for i, r in enumerate(corpus(random.Random(3), 6, 2, 1))]
    monkeypatch.setattr(nj, "BLOCK", 16)
    assert found(spark, rows) == brute(rows)


def test_long_chains_meet_by_buckets(spark, monkeypatch):
    """Sliding windows: a long chain of candidates, of which few pairs are linked."""
    words = [f"w{i}" for i in range(5000)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 120])) for i in range(400)] + [(1000 + i, r[1]) for i, r in enumerate(corpus(random.Random(3), 6, 3, 1))]
    monkeypatch.setattr(nj, "BLOCK", 4)
    met, chains = [], nj._chains

    def counted(*given):
        out = chains(*given)
        met.append(out.count())
        return out

    monkeypatch.setattr(nj, "_chains", counted)
    out = found(spark, rows)
    assert met == [1] and out == brute(rows)


def test_more_names_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nj, "MOST_NAMES", 2)
    rows = corpus(random.Random(6), 6, 3, 2)
    rows += rows[:7]
    assert found(spark, rows) == brute(rows)
    kept = nj.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({r[1] for r in brute(rows)})


def test_clashing_names(spark):
    rows = [(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, same int, component string")
    assert [tuple(r) for r in nj.representatives(docs).collect()] == rows[:1]


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, "a b c d e f", "x", 3)], "doc_id long, text string, same string, h1 int") == [(5, 5, 0, 1)]


def test_posterior_bounds():
    need = nj.least_matches()
    assert need == sorted(need) and all(m < 0.8 * n for m, n in zip(need, range(nj.STEP, nj.COMPARED + 1, nj.STEP)))
    rng = np.random.default_rng(0)
    draws = rng.random((200_000, nj.COMPARED)) < 0.8
    lost = np.zeros(len(draws), bool)
    for k, m in enumerate(need):
        lost |= draws[:, : (k + 1) * nj.STEP].sum(1) < m
    assert lost.mean() < 2e-3


def test_common_counts():
    dice = np.random.default_rng(1)
    sets = [np.unique(dice.integers(0, 60, 25).astype(np.uint64)) for _ in range(9)]
    left, right = np.array([0, 2, 3]), np.array([1, 2, 8])
    want = [[len(np.intersect1d(sets[i], sets[j])) if i != j else None for j in right] for i in left]
    got = nj.common(sets, left, right, columns=7)
    assert all(w is None or g == w for a, b in zip(got, want) for g, w in zip(a, b))


def test_one_of_each_class_stays(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e, f g"), (2, "x y z"), (2, "x y z"), (None, "a b c d e f g"), (9, None)]
    kept = nj.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 9] and kept.columns == ["doc_id", "text"]


def test_repeated_ids_lose_no_class(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (3, b + " more"), (4, c), (4, None), (4, "?!"), (5, c + " more"), (1, c)]
    for order in (rows, rows[::-1]):
        kept = nj.representatives(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, a), (1, c), (2, b), (4, None), (4, "?!")], key=str)
