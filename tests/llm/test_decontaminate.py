import random
import tracemalloc

import numpy as np
import pytest

from colloquy.llm import decontaminate as dc
from colloquy.llm.words import word_hashes


def distance(a, t):
    d = list(range(len(a) + 1))
    best = d[-1]
    for c in t:
        p, d = d, [0]
        for i, x in enumerate(a):
            d.append(min(p[i + 1] + 1, d[i] + 1, p[i] + (x != c)))
        best = min(best, d[-1])
    return best


def test_edit_distance():
    dice = random.Random(1)
    for _ in range(500):
        a, t = [dice.randrange(4) for _ in range(dice.randint(1, 80))], [dice.randrange(4) for _ in range(dice.randint(0, 90))]
        best, end = dc.edit_distance_within(a, t)
        assert best == distance(a, t) and (best == len(a) or distance(a, t[:end]) == best)


def edited(dice, words, n):
    words = list(words)
    for _ in range(n):
        at, kind = dice.randrange(len(words)), dice.randrange(3)
        words[at : at + 1] = [[f"n{dice.randrange(10**9)}"], [], [f"n{dice.randrange(10**9)}", words[at]]][kind]
    return words


def planted(dice, items, share):
    vocabulary = [f"w{i}" for i in range(400)]
    rows, want = [], set()
    for i in range(300):
        words = [dice.choice(vocabulary) for _ in range(dice.randint(0, 120))]
        if i % 3 == 0:
            k = dice.randrange(len(items))
            at = dice.randint(0, len(words))
            words[at:at] = edited(dice, items[k].lower().split(), int(dc.edits_of(len(items[k].split())) * share))
            want.add((i, k))
        rows.append((i, " ".join(words)))
    return rows, want


def test_planted_leaks_are_found_and_nothing_else(spark):
    dice = random.Random(2)
    items = [" ".join(f"W{dice.randrange(400)}" for _ in range(dice.randint(15, 60))) for _ in range(40)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for share, least in ((0, 1.0), (0.5, 0.97), (1, 0.93)):
        rows, want = planted(dice, items, share)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {(r["doc_id"], r["item_id"]): r for r in dc.leaks(docs, benchmark).collect()}
        assert set(got) <= want and len(set(got) & want) >= least * len(want)
        text = dict(rows)
        for (d, k), r in got.items():
            assert r["edits"] == distance(items[k].lower().split(), text[d].split()) <= dc.edits_of(r["n_words"])
        clean = {r["doc_id"] for r in dc.decontaminated(docs, benchmark).collect()}
        assert clean == {i for i, _ in rows} - {d for d, _ in got}


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(dc, "INDEX_BYTES", 6000)
    item = "one two three four five six seven eight"
    bench = [(1, item), (2, None), (None, "x y z a b c"), (3, "too short item"), (4, item.upper()), (5, "alpha beta gamma delta epsilon zeta eta")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    rows = [(1, None, 0), (2, "", 1), (3, f"Say: {item}!", 2), (3, f"Say: {item}!", 2), (None, item, 3), (4, "too short item", 4), (5, item + " " + "zz " * 60000 + item, 5), (6, "one two three four five six seven", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits int")
    got = [(r["doc_id"], r["item_id"], r["start_word"], r["end_word"]) for r in dc.leaks(docs, benchmark).collect()]
    assert sorted(got, key=str) == sorted([(4, 3, 0, 3), (6, 1, 0, 7), (6, 4, 0, 7), *((d, k, s, s + 8) for d, s in ((3, 1), (3, 1), (None, 0), (5, 0)) for k in (1, 4))], key=str)
    kept = dc.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2}
    assert dc.leaks(docs, benchmark.limit(0)).count() == 0 and dc.decontaminated(docs, benchmark.limit(0)).count() == len(rows)
    assert dc.leaks(docs.limit(0), benchmark).count() == 0


def test_embedding_does_not_depend_on_the_batch():
    hashes, offsets = word_hashes(["a b c d e f g h i j k l", "q r s"])
    for window in (4, 8, 64):
        for walk in range(3):
            starts = np.arange(4)
            whole = dc.embed(hashes, starts, np.full(4, 12), window, walk)
            alone = dc.embed(hashes[:12], starts, np.full(4, 12), window, walk)
            assert np.array_equal(whole, alone)


def test_short_items_among_long_ones_are_found():
    dice = np.random.default_rng(4)
    sizes = [23, 24, 27] * 6 + [59, 120, 200] * 60
    items = [dice.integers(1 << 62, size=n).astype(np.uint64) for n in sizes]
    indexes = {ix.window: ix for ix in dc.build(list(enumerate(items)))}
    for n in (23, 24, 27):
        index = indexes[dc.window_of(n)[0]]
        found = trials = 0
        for k in [k for k, size in enumerate(sizes) if size == n]:
            for _ in range(50):
                text = [*dice.integers(1 << 62, size=int(dice.integers(8))).tolist(), *items[k].tolist(), *dice.integers(1 << 62, size=20).tolist()]
                lead = len(text) - n - 20
                for e in range(dc.edits_of(n)):
                    at, new = lead + int(dice.integers(n - e)), int(dice.integers(1 << 62))
                    text[at : at + 1] = [[new], [], [new, text[at]]][int(dice.integers(3))]
                words = np.array(text, np.uint64)
                _, item, _ = index.hits(words, np.array([0, len(words)]))
                found += bool((item == k).any())
                trials += 1
        assert found >= 0.97 * trials


def test_short_items_are_matched_exactly(spark):
    bench = [(1, "alpha"), (2, "Beta, gamma"), (3, "one two three four"), (4, "beta gamma"), (5, "!?"), (6, "five six seven eight nine")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    rows = [(1, "x alpha y"), (2, "alphabet beta x gamma"), (3, "so beta gamma beta gamma"), (4, "one two three"), (5, "four one two three four"), (6, "one two three x four"), (7, "beta"), (8, "gamma five six seven eight nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"], r["item_id"], r["edits"], r["n_words"], r["start_word"], r["end_word"]) for r in dc.leaks(docs, benchmark).collect())
    assert got == [(1, 1, 0, 1, 1, 2), (3, 2, 0, 2, 1, 3), (3, 4, 0, 2, 1, 3), (5, 3, 0, 4, 1, 5), (8, 6, 0, 5, 1, 6)]
    assert {r["doc_id"] for r in dc.decontaminated(docs, benchmark).collect()} == {2, 4, 6, 7}


def test_against_an_exhaustive_search(spark):
    """Every item against every text, by the whole table of edit distances."""
    dice = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [" ".join(dice.choices(vocabulary, k=dice.randint(1, 40))) for _ in range(25)]
    rows = []
    for i in range(150):
        words = dice.choices(vocabulary, k=dice.randint(0, 80))
        for _ in range(dice.randint(0, 2)):
            k, at = dice.randrange(len(items)), dice.randint(0, len(words))
            n = len(items[k].split())
            words[at:at] = edited(dice, items[k].split(), dice.randint(0, dc.edits_of(n) + 1)) if n > 4 else items[k].split()
        rows.append((i, " ".join(words)))
    want = {}
    for d, text in rows:
        for k, item in enumerate(items):
            n = distance(item.split(), text.split())
            if n <= dc.edits_of(len(item.split())):
                want[d, k] = n
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in dc.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert len(want) > 100 and got.items() <= want.items() and len(got) >= 0.98 * len(want)


def test_one_word_over_and_over(monkeypatch):
    """Neither an item of one repeated word nor items that share a passage are written out by all their agreements."""
    monkeypatch.setattr(dc, "AT_ONCE", 5000)
    hashes, offsets = word_hashes(["w " * 60, *("same " + f"a b c d e f g h i j k l m n o p q r s t u v end{i}" for i in range(200))])
    items = [hashes[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    words, at = word_hashes(["w " * 4000, "a b c d e f g h i j k l m n o p q r s t u v " * 3])
    assert [(p.start, p.stop) for p in dc._portions(np.array([0, 9000, 1, 1, 4000, 4000]))] == [(1, 2), (2, 5), (5, 6)]
    tracemalloc.start()
    index = dc.build(list(enumerate(items)))
    base = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    found = list(dc._verify(index, items, words, at))
    peak = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    assert (0, 0, 0, 0, 60) in found and {f[1] for f in found if f[0] == 1} == set(range(1, 201)) and peak < 40 << 20


@pytest.mark.parametrize("sizes", [range(1, 31), range(31, 61), range(61, 301, 17)])
def test_recall_of_every_length_at_the_most_edits(sizes):
    """In one mixed benchmark, at least 0.9 for each length."""
    dice = np.random.default_rng(12)
    per, texts = 4, 15
    items = [dice.integers(1 << 62, size=n).astype(np.uint64) for n in sizes for _ in range(per)]
    index, phrases = dc.build(list(enumerate(items))), dc.Phrases.of(items)
    for s, n in enumerate(sizes):
        found = 0
        rows, owner = [], []
        for k in range(s * per, (s + 1) * per):
            for _ in range(texts):
                text = items[k].tolist()
                for e in range(dc.edits_of(n)):
                    at, new = int(dice.integers(len(text))), int(dice.integers(1 << 62))
                    text[at : at + 1] = [[new], [], [new, text[at]]][int(dice.integers(3))]
                rows.append([*dice.integers(1 << 62, size=int(dice.integers(20))).tolist(), *text, *dice.integers(1 << 62, size=20).tolist()])
                owner.append(k)
        words, offsets = np.array([w for r in rows for w in r], np.uint64), np.cumsum([0, *map(len, rows)])
        got = {(f[0], f[1]) for f in [*phrases.find(words, offsets), *dc._verify(index, items, words, offsets)]}
        found = sum((t, k) in got for t, k in enumerate(owner))
        assert found >= 0.9 * len(owner), (n, found, len(owner))
