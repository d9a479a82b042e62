import hashlib
import itertools
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloquy.llm import align as al
from colloquy.llm import scratch

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the", "Word", " ", "  ", "\n", "\t", "'s", "'LL", "é", "é", "日本", "한", "🎉", "\x85", "\xa0", "　", "᠎", "\x1c", "12", "!!", "̈", "<|endoftext|>", "▁", "<s>", "<0x41>", "\x00", "\r\n", "a.b", " ", "supercalifragilistic"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=14).map("".join)


class Plain:
    """Both libraries on whole texts, and overlaps from token spans, pair by pair."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        self.bytes_a = lambda i: bytes(byte[c] for c in names[i])
        self.bytes_b = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def __call__(self, text):
        """(tokens of A, of B, groups, links)"""
        if not text:
            return [], [], [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if any(b"".join(map(f, ids)) != (" " + text).encode() for f, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            return [], [], [], []
        spans = []
        for f, ids in ((self.bytes_a, a), (self.bytes_b, b)):
            ends = list(itertools.accumulate(len(f(i)) for i in ids))
            spans.append(list(zip([0, *ends], ends, ids)))
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if max(x[0], y[0]) < min(x[1], y[1])]
        cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        groups = [tuple([x[2] for x in s if lo <= x[0] < hi] for s in spans) for lo, hi in zip([0, *cuts], cuts)]
        return a, b, groups, links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def expected(plain, texts):
    found = [plain(t) for t in texts]
    counts = Counter(link for x in found for link in x[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for a, b, groups, links in found:
        told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(told.encode()).hexdigest() if links else ""))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_one_text_is_as_the_libraries_have_it(text):
    plain, models = _plain(), _aligner()
    row = al.read(models, [text], True)[0]
    a, b, groups, links = plain(text)
    if not links:
        assert row is None
        return
    assert row.figures.tolist() == [len(a), len(b), len(groups), len(links)]
    assert [(g["a"], g["b"]) for g in row.groups] == groups
    assert Counter(dict(zip(*(x.tolist() for x in row.links())))) == Counter(x << 32 | y for x, y in links)


_made = {}


def _plain():
    if "plain" not in _made:
        _made["plain"] = Plain()
    return _made["plain"]


def _aligner():
    return al.aligner(A, B)


@given(TEXT, st.integers(1, 9))
def test_blocks_are_the_text(text, size):
    old, al.BLOCK = al.BLOCK, size
    try:
        assert "".join(al.blocks(text)) == text
    finally:
        al.BLOCK = old


def test_the_fast_encoder_cuts_as_the_library_does():
    """Every character beside letters, digits, signs and white space."""
    models, library = _aligner().a, _plain().a
    for start in range(0, 0x110000, 0x400):
        text = "".join(f"a{c}1{c}{c}! {c} ,\n{c} b" for c in map(chr, range(start, start + 0x400)) if not "\ud800" <= c <= "\udfff")
        assert models.encode([text])[0] == library.encode(text, add_special_tokens=False).ids
    for text in (" " * 100_000, "x" + "\n" * 100_000 + "y", "\t " * 1100):
        assert models.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_owners_and_overlaps():
    a, b, begins = al.overlaps(*map(al.np.array, ([2, 3, 1], [1, 1, 3, 1])))
    assert (a.tolist(), b.tolist(), begins.tolist()) == ([0, 0, 1, 2], [0, 1, 2, 3], [True, False, True, True])


def test_equals_brute_force(spark, plain):
    dice = random.Random(5)
    texts = ["".join(dice.choice(PARTS[:-2]) for _ in range(dice.randint(1, 40))) for _ in range(120)]
    texts += [None, "", " ", "▁", "plain words here", "plain words here", "x" * 3000, "word " * 4000]
    rows = [(i % 100, t, "mine", -1) for i, t in enumerate(texts)]
    out = al.align(spark.createDataFrame(rows, "doc_id long, text string, N_A string, count_sum long").repartition(3), A, B, want=("text",))
    assert out.columns == ["doc_id", "text", *NAMES]
    got = sorted((r["text"] or "", *(r[n] for n in NAMES)) for r in out.collect())
    assert got == sorted((t or "", *x) for t, x in zip(texts, expected(plain, texts)))


def test_small_blocks_and_joined_counts_change_nothing(spark, plain, monkeypatch):
    """Blocks are tried in this process; the joined counts in Spark."""
    dice = random.Random(6)
    texts = [" ".join(dice.choice(["alpha", "beta", "gamma", "delta", "ω", "x▁y" if i == 4 else "z"]) for _ in range(dice.randint(1, 300))) for i in range(30)]
    texts += [None, "", "the last one ▁", "é" * 500]
    want = expected(plain, texts)
    monkeypatch.setattr(al, "BLOCK", 200)
    rows = al.read(al.aligner(A, B), texts)
    assert [tuple(r.figures) if r else (0,) * 4 for r in rows] == [x[:4] for x in want]
    assert [r.sha.hexdigest() if r else "" for r in rows] == [x[6] for x in want]
    pairs = Counter()
    for r in rows:
        pairs.update(dict(zip(*(x.tolist() for x in r.links()))) if r else {})
    assert pairs == Counter(x << 32 | y for t in texts for x, y in plain(t)[3])
    monkeypatch.undo()
    monkeypatch.setattr(al, "MOST_PAIRS", 3)
    monkeypatch.setattr(scratch, "MOST_BROADCAST", 3)
    out = al.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in NAMES) for r in out] == want


def test_groups_are_given(spark, plain):
    text = "Über naïve façades: 日本語 and\n\nthe rest " * 3
    row = al.align(spark.createDataFrame([(1, text, "g")], "doc_id long, text string, groups string"), A, B, want=("groups",)).first()
    raw, groups = (" " + text).encode(), row["groups"]
    assert [(g["a"], g["b"]) for g in groups] == plain(text)[2]
    assert groups[0]["start"] == 0 and groups[-1]["end"] == len(raw) and all(x["end"] == y["start"] for x, y in zip(groups, groups[1:]))
    for g in groups:
        assert b"".join(map(plain.bytes_a, g["a"])) == b"".join(map(plain.bytes_b, g["b"])) == raw[g["start"] : g["end"]]


def test_empty_table(spark):
    assert al.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
