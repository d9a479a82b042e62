"""Summaries choose among sentences as the column expressions did that compared every pair, and a text goes to Python once."""

import random

from pyspark.sql import functions as F

from colloquy import lexicons as L
from colloquy.functions import rules as R
from colloquy.functions import text as T
from colloquy.functions.rowwise import by_row
from colloquy.functions.tokens import default_lexicon, long_words, segment, tokens, within_latin
from colloquy.operators import keywords, sentences
from colloquy.plans import summary
from colloquy.queries import QUERIES

SIGNS = [*"ab ,.;'\"é\xa0\n，。、；！“", "  ", "the ", "ly", "项目", "会议", "讨论", "是是是", ",,", "..", "好的，", "등", " ", "1%"]
KNOWN = frozenset(default_lexicon())


def texts(n, seed, most=40):
    dice = random.Random(seed)
    return ["".join(dice.choice(SIGNS[: dice.choice((10, len(SIGNS)))]) for _ in range(dice.randint(0, most))) for _ in range(n)]


def test_long_words_are_those_of_all_words():
    longest = max(map(len, KNOWN))
    for t in [*texts(3000, 1), *(chr(i) * 2 + "a" + chr(i) for i in range(0x250))]:
        assert long_words(t, KNOWN, longest) == [w for w in segment(t, KNOWN, longest) if len(w) > 1]
    assert within_latin("é\xff") and not within_latin("éĀ") and not any(map(within_latin, (*L.STOP_WORDS_ZH, *KNOWN)))


def test_rules_that_need_other_signs_are_passed_by():
    import re

    for t in texts(6000, 2):
        for name in R.NAMED:
            want = t.strip()
            for pattern, replacement in R.NAMED[name]():
                want = re.sub(pattern, replacement, want)
            assert R.named(name)(t) == want.strip()
    assert len(R.named("narrated")._latin) == 1 and len(R.named("tidied")._latin) == 3
    assert not any(map(R.beyond, ("[一-龥]*a", "([一])?a", "[，,]+", "一|a", "[一]{0,2}a", "a一?"))) and all(map(R.beyond, ("[、]{2,}", r"([一-龥]{2,})\1{1,}", "a一")))
    assert [R.signs(p) for p in ("[，,、；;]\\s*$", "[“\"\\']", "[a]*", "[a-c]", "a", "[a]b|c", r"[\s]a", "[,]{0,2}a")] == [",;", "\"'", "", "", "", "", "", ""]


def counted(text, words):
    """Topics as column expressions."""
    out = []
    for k, (topic, own) in enumerate(words.items()):
        counts = F.transform(F.array(*map(F.lit, own)), lambda w: T.count_of(text, w))
        found = F.size(F.filter(counts, lambda c: c > 0)).cast("long")
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c)
        score = found / len(own) * 0.6 + F.least(total / F.greatest(F.length(text) / 100, F.lit(1.0)), F.lit(1.0)) * 0.4
        out.append(F.struct((-score).alias("o"), F.lit(k).alias("k"), F.lit(topic).alias("topic"), F.bround(score, 4).alias("score"), found.alias("keyword_hits"), total.alias("total_hits")))
    return F.transform(F.slice(F.array_sort(F.array(*out)), 1, 5), lambda t: F.struct(t["topic"], t["score"], t["keyword_hits"], t["total_hits"]))


def test_topics_equal_those_of_expressions(spark):
    dice, words = random.Random(3), [w for ws in L.TOPICS.values() for w in ws] + ["the", "是是", "abc"]
    rows = [("".join(dice.choice(words) + dice.choice(["", "，", "好" * 30]) for _ in range(dice.randint(0, 40))),) for _ in range(60)] + [(None,), ("",), ("aaaa bb é",)]
    df = spark.createDataFrame(rows, "t string")
    own = {"x": ["aa", "b", "b"], "y": ["是是", "the"], "z": ["é"]}
    for given in (L.TOPICS, own):
        for r in df.select(keywords.keyword_topics(F.col("t"), None, given).alias("a"), counted(F.col("t"), given).alias("b")).collect():
            assert [tuple(x) for x in r["a"]] == [tuple(x) for x in r["b"]]


def test_what_a_summary_says_equals_the_folds(spark):
    dice = random.Random(5)
    pool = [t for t in texts(60, 6, 14)]
    some = lambda n: [dice.choice(pool) + dice.choice(["", "", " more words here"]) for _ in range(dice.randint(0, n))]
    rows = [(i, dice.choice([None, "本次会议围绕项目展开讨论。", dice.choice(pool)]), some(15), some(8), some(3)) for i in range(250)]
    df = spark.createDataFrame(rows, "id int, head string, good array<string>, spare array<string>, actions array<string>")
    got = {r["id"]: (r["s"]["before"], r["s"]["fresh"]) for r in df.select("id", by_row(summary.SAID, summary.chosen(), F.col("head"), F.col("good"), F.col("spare"), F.col("actions")).alias("s")).collect()}

    item = "array<struct<text: string, tokens: array<string>>>"
    split = lambda c: by_row(item, lambda every: [(x, segment(x, KNOWN, max(map(len, KNOWN)))) for x in every], c)
    old = df.select("id", "head", split(F.col("good")).alias("good"), split(F.col("spare")).alias("spare"), split(F.col("actions")).alias("actions"), tokens(F.coalesce("head", F.lit(""))).alias("t"))
    near = lambda x, y: T.token_jaccard(x["tokens"], y["tokens"])
    same = lambda x, y: T.signature(x["tokens"]) == T.signature(y["tokens"])
    old = old.withColumn("h", F.struct(F.coalesce("head", F.lit("")).alias("text"), F.col("t").alias("tokens"))).withColumn("kept", sentences.suppress_repeats(F.col("good"), lambda x, y: same(x, y) | (near(x, y) > 0.6), 6))
    old = old.withColumn("kept", F.when(F.size("kept") > 0, F.col("kept")).otherwise(sentences.suppress_repeats(F.col("spare"), same, 5)))
    old = old.withColumn("core", F.slice(F.filter("kept", lambda x: (F.length(x["text"]) >= 15) & ~(F.col("head").isNotNull() & (near(x, F.col("h")) > 0.4))), 1, 4))
    old = old.withColumn("before", F.when(F.col("head").isNotNull(), F.concat(F.array("h"), F.col("core"))).otherwise(F.col("core")))
    old = old.select("id", F.transform("before", lambda x: x["text"]).alias("b"), F.transform(F.slice(F.filter("actions", lambda x: ~F.exists("before", lambda y: near(x, y) > 0.5)), 1, 2), lambda x: x["text"]).alias("f"))
    want = {r["id"]: (r["b"], r["f"]) for r in old.collect()}
    assert got == want and any(f for _, f in want.values())


def test_action_items_need_a_stop(spark):
    rows = [(t,) for t in ("需要完成测试工作的报告", "需要完成测试工作的报告。", "决定按预算执行成本控制！好", "谁负责跟进落实？", "need this. And that", "", None)]
    found = spark.createDataFrame(rows, "t string").select(T.action_items(F.col("t")).alias("a"), T.action_items(F.col("t"), L.ACTION_PATTERNS_ZH).alias("b")).collect()
    assert [r["a"] for r in found] == [r["b"] for r in found] and [bool(r["a"]) for r in found] == [False, True, True, True, False, False, False]
    assert all(p.endswith("[。！？]") for p in L.ACTION_PATTERNS_ZH)


def test_a_text_goes_to_python_once_and_pairs_are_not_compared_by_expressions(spark):
    plan = QUERIES["documents_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "Join" not in plan
    assert "array_sort" not in plan and "array_intersect" not in plan and "replace(text" not in plan
    assert all(any("一" <= c <= "龥" for c in p) for p in L.SMALL_TALK)
