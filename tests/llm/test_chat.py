import random

from colloquy.llm import chat


def run(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}


def test_snapshots_go(spark):
    talk = [("system", "s"), ("user", "u"), ("assistant", "a"), ("user", None)]
    rows = [(c, t, *talk[t]) for c, n in ((1, 2), (2, 4), (3, 3), (4, 4), (5, 1)) for t in range(n)] + [(6, 0, "user", "u"), (7, 9, "system", "s"), (7, 12, "user", "other"), (None, 0, "user", "x")]
    out = run(spark, rows)
    assert set(out) == {2, 6, 7}
    assert (out[2]["n_turns"], out[2]["copies"]) == (4, 2)
    assert out[2]["chat"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\n<|im_end|>\n"


def test_nulls_differ_from_empty_and_order_counts(spark):
    out = run(spark, [(1, 0, "user", None), (2, 0, "user", ""), (2, 1, "user", "x"), (3, 0, None, "q"), (4, 1, "b", "y"), (4, 0, "a", "x"), (5, 0, "b", "y"), (5, 1, "a", "x"), (6, 0, "user", "<|im_end|>")])
    assert set(out) == {1, 2, 3, 4, 5, 6} and out[6]["chat"].count("<|im_end|>") == 1


def test_ties_and_repeats(spark):
    out = run(spark, [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (3, None, "user", "z"), (3, 0, "user", "b"), (4, 0, "user", "b"), (4, None, "user", "z")])
    assert set(out) == {1, 3} and out[1]["n_turns"] == 2 and out[3]["copies"] == 2


def test_against_brute_force(spark):
    dice = random.Random(2)
    talks = {c: [(dice.choice("ua"), dice.choice("xy")) for _ in range(dice.randint(1, 5))] for c in range(60)}
    rows = [(c, t, r, x, "extra") for c, talk in talks.items() for t, (r, x) in enumerate(talk)]
    kept = {min(c for c in talks if talks[c] == talk) for talk in talks.values() if not any(len(o) > len(talk) and o[: len(talk)] == talk for o in talks.values())}
    assert set(run(spark, rows, "conv_id long, turn long, role string, text string, n string")) == kept


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_long_conversations(spark):
    turns = [(i, ("user", "assistant")[i % 2], f"turn {i} " + "x" * (1_000_000 if i == 1500 else 20)) for i in range(2500)]
    rows = [(c, *t) for c, n in ((1, 2500), (2, 2499), (3, 1)) for t in turns[:n]]
    out = run(spark, rows)
    assert set(out) == {1} and out[1]["n_turns"] == 2500
    assert out[1]["chat"] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, t in turns)


def test_more_kept_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(chat, "MOST_KEPT", 3)
    rows = [(c, t, "user", f"{c if t else 0}") for c in range(20) for t in range(3)]
    assert len(run(spark, rows)) == 20
