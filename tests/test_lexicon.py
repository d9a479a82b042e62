"""Words of text without spaces: the paths and tags against all possible ones, and words that were planted."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.operators import lexicon

SIGNS = "一丁七万丈"
WORD = st.text(SIGNS, min_size=1, max_size=4)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(WORD, st.floats(-9, 0), max_size=40), st.text(SIGNS + "x", max_size=12))
def test_trie_finds_what_a_table_does(words, text):
    trie = lexicon.Trie(words)
    for start in range(len(text) + 1):
        assert list(trie.found(text, start)) == [(end, words[text[start:end]]) for end in range(start + 1, len(text) + 1) if text[start:end] in words]


def test_large_trie():
    dice = random.Random(1)
    words = {"".join(chr(0x4E00 + dice.randrange(3000)) for _ in range(dice.randint(1, 4))): float(k) for k in range(20_000)}
    trie = lexicon.Trie(words)
    for w in dice.sample(sorted(words), 2000):
        assert dict(trie.found(w, 0))[len(w)] == words[w]


def cuts(run):
    for k in range(len(run)):
        for at in itertools.combinations(range(1, len(run)), k):
            yield [run[i:j] for i, j in zip([0, *at], [*at, len(run)])]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(WORD, st.integers(1, 50), max_size=25), st.text(SIGNS, min_size=1, max_size=9))
def test_path_is_the_best_of_all(counts, run):
    model = lexicon.Model(counts)
    total = sum(counts.values()) + 1.0

    def value(words):
        return sum(math.log(counts[w] / total) if w in counts else model.unknown if len(w) == 1 else -math.inf for w in words)

    found = model.path(run)
    assert "".join(found) == run and value(found) == pytest.approx(max(map(value, cuts(run))))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(WORD, st.sampled_from("nva"), max_size=8), st.dictionaries(st.tuples(st.sampled_from("nva"), st.sampled_from("nva")), st.integers(0, 30).map(float)), st.lists(WORD, min_size=1, max_size=6))
def test_tags_are_the_best_of_all(tags, follows, words):
    model = lexicon.Model({w: 1.0 for w in words}, tags, follows)
    at = {t: i for i, t in enumerate(model.names)}

    def value(own):
        return -math.inf if any(tags.get(w, t) != t for w, t in zip(words, own)) else sum(model._moves[at[a], at[b]] for a, b in zip(own, own[1:]))

    found = model.tagged(words)
    best = max(value(x) for x in itertools.product(model.names, repeat=len(words)))
    assert best > -math.inf and value(found) == pytest.approx(best)


def corpus(n=400, seed=2):
    """Sentences of words of two and three signs, drawn evenly."""
    dice = random.Random(seed)
    signs = [chr(0x4E00 + 7 * k) for k in range(400)]
    words = ["".join(dice.sample(signs, dice.choice([2, 3]))) for _ in range(60)]
    return words, [[dice.choice(words) for _ in range(dice.randint(3, 12))] for _ in range(n)]


def test_planted_words_are_learned_and_found(spark):
    words, told = corpus()
    df = spark.createDataFrame([(i, "。".join(["".join(s)]) + ("abc 12" if i % 3 else "")) for i, s in enumerate(told)] + [(-1, None), (-2, "")], "id int, text string").repartition(3)
    found = {r["word"] for r in lexicon.learned_words(df).collect()}
    assert found == set(words)
    model = lexicon.learn(df)
    rows = df.where("id >= 0").select("id", lexicon.path_tokens(F.col("text"), model).alias("w")).collect()
    for r in rows:
        assert [w for w in r["w"] if "一" <= w[0]] == told[r["id"]]
        assert ("abc" in "".join(r["w"])) == bool(r["id"] % 3)
    tagged = {r["id"]: r["t"] for r in df.select("id", lexicon.path_tagged(F.col("text"), model).alias("t")).collect()}
    assert tagged[-1] == tagged[-2] == [] and {x["tag"] for x in tagged[1]} == {"n", "eng"}


def test_transitions_and_numbers_of_the_whole_corpus(spark):
    words, told = corpus()
    tags = {w: "nv"[i % 2] for i, w in enumerate(words[:50])}
    df = spark.createDataFrame([("".join(s),) for s in told], "text string").repartition(4)
    model = lexicon.learn(df, tags)
    want = {}
    for s in told:
        for a, b in zip(s, s[1:]):
            if a in tags and b in tags:
                want[tags[a], tags[b]] = want.get((tags[a], tags[b]), 0) + 1
    assert model.follows == want
    grams = {r["gram"]: r["n"] for r in lexicon.gram_counts(df, 2).collect()}
    runs = ["".join(s) for s in told]
    assert grams == {g: sum(sum(r[i : i + len(g)] == g for i in range(len(r))) for r in runs) for g in grams} and max(map(len, grams)) == 3


def test_empty_corpus_and_too_many_words(spark, monkeypatch):
    assert lexicon.learned_words(spark.createDataFrame([], "text string")).collect() == []
    assert lexicon.learn(spark.createDataFrame([(None,)], "text string")).words("一丁 a") == ["一", "丁", " ", "a"]
    monkeypatch.setattr(lexicon, "MOST_WORDS", 1)
    with pytest.raises(ValueError):
        lexicon.Model({"一": 1, "丁": 1})


def test_a_long_run_takes_time_in_proportion():
    words, told = corpus()
    model = lexicon.Model(dict.fromkeys(words, 5.0))
    run = "".join(w for s in told for w in s) * 20
    assert np.array(model.path(run)).tolist() == [w for s in told for w in s] * 20
