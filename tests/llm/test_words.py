import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import words

TEXT = st.text(alphabet=st.sampled_from("abAÉé _1.,-\n\t—«ß日"), max_size=60)


def plain(text):
    return re.findall(r"\w+", (text or "").lower())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_equal_words_have_equal_hashes(texts):
    hashes, offsets = words.word_hashes(texts)
    seen = {}
    for i, t in enumerate(texts):
        own = plain(t)
        assert offsets[i + 1] - offsets[i] == len(own)
        for w, h in zip(own, hashes[offsets[i] : offsets[i + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_texts_go_through_in_pieces(monkeypatch):
    texts = ["alpha beta " * 500, None, "", "x" * 5000, "gamma", "one two " * 700]
    whole = words.word_hashes(texts)
    monkeypatch.setattr(words, "_SLICE", 1000)
    parts = words.word_hashes(texts)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


@settings(max_examples=100, deadline=None)
@given(TEXT, TEXT)
def test_sets_meet_as_sets_of_runs_do(a, b):
    def runs(t):
        w = plain(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    x, y = words.shingle_sets(*words.word_hashes([a, b]))
    assert len(x) == len(runs(a)) and len(y) == len(runs(b))
    assert len(np.intersect1d(x, y)) == len(runs(a) & runs(b))
