"""Rewrite rules as data, summaries on a text's own row, and ranks without a matrix of sentences."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy import lexicons as L
from colloquy.functions import rules as R
from colloquy.functions.tokens import tagged
from colloquy.operators import keywords, sentences
from colloquy.queries import QUERIES

EVERY = [(p, r) for name in R.NAMED for p, r in R.NAMED[name]()]
BITS = [b for p, _ in EVERY if (b := re.sub(r"[\^\\\[\](){}.*+?|$s]", "", p))] + list("，。、的了是一a 3,“") + ["好的，", "还有", "讨论一下", "等等"]


def plain(text, name):
    text = text.strip()
    for pattern, replacement in R.NAMED[name]():
        text = re.sub(pattern, replacement, text)
    return text.strip()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=12).map("".join))
def test_rules_are_applied_one_after_the_other(text):
    for name in R.NAMED:
        assert R.named(name)(text) == plain(text, name)


def test_beginnings():
    assert [R.beginning(p) for p in ("我们公司", "^还有[，,]?", "对了*", "a|b", "[，,]{2,}", "([一-龥])\\1", "等等$", "x\\s", "", "^")] == ["我们公司", "还有", "对", "", "", "", "等等", "x", "", ""]


def test_rules_in_spark(spark):
    dice = random.Random(1)
    texts = ["".join(dice.choice(BITS) for _ in range(dice.randint(1, 12))) for _ in range(200)] + [None, "", "  　"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.narrated(F.col("t")).alias("n"), R.tidied(F.col("t")).alias("d"), R.all_rewritten(F.array("t", F.lit("好的，我们讨论")), "narrated", "tidied").alias("a")).orderBy("i").collect()
    for t, r in zip(texts, rows):
        assert (r["n"], r["d"]) == ((plain(t, "narrated"), plain(t, "tidied")) if t is not None else (None, None))
        assert r["a"] == [plain(plain(t, "narrated"), "tidied") if t is not None else None, "会议讨论"]


def test_best_words_are_those_of_the_table(spark):
    dice = random.Random(2)
    words = [w for ws in L.TOPICS.values() for w in ws]
    rows = [(i, "".join(dice.choice(words) + dice.choice(["，", "。", "的", "\n"]) for _ in range(dice.randint(1, 60)))) for i in range(30)] + [(98, ""), (99, "abc def。abc")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("tagged", tagged(F.col("text"))).cache()
    want = {}
    for r in keywords.keywords_zh(df, "id", n=8).orderBy("id", "rank").collect():
        want.setdefault(r["id"], []).append((r["word"], r["frequency"], r["score"]))
    for r in df.select("id", keywords.best_words(F.col("text"), F.col("tagged"), 8).alias("w")).collect():
        assert [(w["word"], w["frequency"], pytest.approx(w["score"], abs=1.01e-4)) for w in r["w"]] == want.get(r["id"], [])


def test_plan_of_a_whole_analysis_is_short(spark):
    df = QUERIES["meeting_analysis"](spark, "/root/testdata/sf0.001")
    assert len(df._jdf.queryExecution().executedPlan().toString()) < 100_000
    assert "Join" not in QUERIES["documents_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def dense_rank(words, damping=0.85, rounds=20, close=0.001):
    """A weight for every pair of sentences."""
    n = len(words)
    weight = np.array([[len(set(a) & set(b)) / min(len(a), len(b)) if i != j and a and b else 0.0 for j, b in enumerate(words)] for i, a in enumerate(words)]).reshape(n, n)
    out = weight.sum(1)
    move = np.divide(weight, out[:, None], out=np.zeros((n, n)), where=out[:, None] > 0)
    scores = np.full(n, 1 / max(n, 1))
    for _ in range(rounds):
        new = (1 - damping) / n + damping * (scores @ move)
        if np.abs(new - scores).sum() < close:
            break
        scores = new
    return scores


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=7), min_size=1, max_size=14))
def test_rank_equals_that_of_all_pairs(words):
    assert np.allclose(sentences.text_rank(words), dense_rank(words))


def test_rank_of_a_long_text_needs_little_memory():
    dice = random.Random(4)
    words = [[f"w{int(dice.paretovariate(0.8))}" for _ in range(12)] for _ in range(20_000)]
    tracemalloc.start()
    scores = sentences.text_rank(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == 20_000 and np.isfinite(scores).all() and peak < 200e6
    assert sentences.text_rank([]).tolist() == []
