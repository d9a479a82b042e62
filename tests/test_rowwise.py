"""Python steps on rows: what is held at a time, in bytes."""

import tracemalloc

import pyarrow as pa
import pytest

from colloquy.functions import rowwise
from colloquy.functions.tokens import segment, tagger
from colloquy.operators.lexicon import Model
from colloquy.sources import files


def most_held(run):
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


WORDS, TAGGED = pa.list_(pa.string()), pa.list_(pa.struct([("word", pa.string()), ("tag", pa.string())]))
MODEL = Model({"会议": 5.0, "项目": 3.0}, {"会议": "n"})


@pytest.mark.parametrize("step,to", [
    (lambda t: segment(t, {"会议", "项目"}, 2), WORDS),
    (tagger(), TAGGED),
    (lambda t: list(zip(w := MODEL.words(t), MODEL.tagged(w))), TAGGED),
])
def test_words_of_a_batch_are_not_held_at_once(monkeypatch, step, to):
    """Ten times the texts hold no more objects, and give the words of each text."""
    monkeypatch.setattr(rowwise, "PART", 2000)
    text = "会议讨论项目好" * 40
    few, many = (most_held(lambda n=n: rowwise.in_parts(step, to, pa.array([text] * n))) for n in (25, 250))
    assert many < 1.3 * few
    own = [text[:7], "", text, text[:3]]
    assert rowwise.in_parts(step, to, pa.array(own)).to_pylist() == [x for t in own for x in pa.array([step(t)], to).to_pylist()]


def test_no_rows_and_missing_values():
    assert rowwise.in_parts(lambda t: t, pa.string(), pa.array([], pa.string())).to_pylist() == []
    assert rowwise.in_parts(lambda t, n: None if t is None else t + n[0], pa.string(), pa.array([None, "a"]), pa.array([["x"], ["y"]])).to_pylist() == [None, "ay"]


def test_chunks_are_joined_without_an_object_for_each():
    chunks = pa.array([bytes([k % 251, 1, 2]) for k in range(100_000)], pa.binary())
    assert bytes(files._joined(chunks[7:9000])) == b"".join(chunks[7:9000].to_pylist()) and bytes(files._joined(chunks[:0])) == b""
    assert most_held(lambda: files._joined(chunks)) < 100_000
    with pytest.raises(ValueError):
        files._joined(pa.array([b"a", None], pa.binary()))
