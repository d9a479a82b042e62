import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloquy.llm import bpe
from colloquy.llm import token_counts as tc

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "the", "Word", " ", "  ", "\n", "\t", "'s", "'LL", "é", "é", "İ", "Σ", "ΑΣ ", "²", "½", "日本", "한", "🎉", "\x85", "\xa0", "　", "12", "!!", "ß", "̈", '"', "’s", "_", "<|endoftext|>", "<|startoftext|>", "▁", "<s>", "\x00", "\r\n", "#", "C++", "a.b", "x²."]
TEXT = st.lists(st.sampled_from(PARTS), max_size=14).map("".join)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES), tc.Lengths(tc.PieceModel(PIECES), {}, room=50)


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(WORDS), bpe.WordBPE(WORDS)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_counts_are_the_librarys(pieces, text):
    assert pieces[1].count(text) == len(pieces[0].encode(text))


def joined(m, text):
    sink = bpe.Sink(True, True)
    bpe.transduce(text, bpe.Words(m), sink)
    ids, decoded = " ".join(map(str, sink.ids)), b"".join(sink.decoded).decode()
    assert sink.digests() == (hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    return ids, decoded, sink.n


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_ids_and_text_are_the_librarys(model, text):
    own = model[0].encode(text, add_special_tokens=False)
    assert joined(model[1], text) == (" ".join(map(str, own.ids)), model[0].decode(own.ids, skip_special_tokens=False), len(own.ids))


@pytest.mark.parametrize("alphabet", ["a", "ab", "etaoinshrdlu", "aeh", "é", "!", "=-"])
def test_long_pre_tokens_stream(model, alphabet):
    dice = random.Random(alphabet)
    text = "".join(dice.choice(alphabet) for _ in range(6000))
    want = model[0].encode(text, add_special_tokens=False).ids
    raw = text.encode()
    for size in (1, 7, 300):
        assert [i for ids in model[1].encode_stream((raw[k : k + size] for k in range(0, len(raw), size)), step=40) for i in ids] == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=4, max_size=60).map("".join), st.integers(3, 20))
def test_blocks_change_nothing(model, text, size):
    whole = joined(model[1], text)
    before, bpe.BLOCK, bpe.LOOK_BACK = (bpe.BLOCK, bpe.LOOK_BACK), size, max(1, size // 2)
    try:
        assert joined(model[1], text) == whole
    finally:
        bpe.BLOCK, bpe.LOOK_BACK = before


@pytest.mark.parametrize("text", ["x" * 700, "ab" * 300 + "é" * 200, "'" * 333 + "s" * 90, "가" * 300 + "한" * 50, "!?" * 200 + "'re" * 120, "a\u0301" * 150, "日本語" * 120, "\u3000".join(["ok"] * 200)])
def test_runs_over_many_blocks(model, monkeypatch, text):
    own = model[0].encode(text, add_special_tokens=False)
    monkeypatch.setattr(bpe, "BLOCK", 64)
    monkeypatch.setattr(bpe, "LOOK_BACK", 16)
    assert joined(model[1], text) == (" ".join(map(str, own.ids)), model[0].decode(own.ids, skip_special_tokens=False), len(own.ids))


@pytest.mark.parametrize("of", ["a", "éa", "!", "the quick brown fox "])
def test_memory_does_not_grow(model, of):
    """Neither with a run without white space nor with a text of many words."""
    words = bpe.Words(model[1])
    peaks = []
    for size in (1 << 18, 1 << 20):
        text = of * (size // len(of))
        bpe.transduce(text[:1000], words, bpe.Sink())
        tracemalloc.start()
        bpe.transduce(text, words, bpe.Sink())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] + 200_000 and peaks[1] < 16 << 20


def test_bytes_come_back(model):
    ids = model[0].encode("the café 日本 !", add_special_tokens=False).ids
    d = bpe.Decoder(model[1], "bytes")
    assert "".join(d.feed([i]) for i in ids) + d.close() == "the café 日本 ! "


def test_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([], "") == 1
    assert bpe.sufficient_lookahead([("a", "b")], "") == 1
    chain = [("c", "d"), ("b", "c"), ("a", "b")]
    assert bpe.sufficient_lookahead(chain, "") == 3  # whether a takes b depends on c, and that on d


def test_columns(spark):
    rows = [(1, None, 7), (2, "", 7), (None, "The cat 's", 7), (4, "The cat 's", 7), (5, "word " * 5000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    counted = tc.count_tokens(docs, PIECES).collect()
    assert [r["n_tokens"] for r in counted[:2]] == [0, 0] and counted[4]["over_limit"] and counted[2]["n_bytes"] == 10
    encoded = bpe.encode(docs, WORDS).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encoded[:2]] == [(0, empty, empty)] * 2
    assert encoded[2]["ids"] == encoded[3]["ids"] == Tokenizer.from_file(WORDS).encode("The cat 's", add_special_tokens=False).ids
    assert hashlib.sha256(encoded[3]["decoded"].encode()).hexdigest() == encoded[3]["decoded_sha256"]
    assert bpe.encode(docs.limit(0), WORDS).count() == 0 and tc.count_tokens(docs.limit(0), PIECES).count() == 0


def test_frequent_pre_tokens_come_from_all_of_a_partition(spark):
    docs = spark.createDataFrame([("early",)] * 3000 + [("late",)] * 3000, "text string").coalesce(1)
    names, lengths = tc.frequent_lengths(docs, PIECES, sample_docs=80, parts=1)
    assert set(names.decode().split("\n")) == {"▁early", "▁late"} and len(lengths) == 4
    assert tc.frequent_lengths(docs.limit(0), PIECES) == (b"", b"")
