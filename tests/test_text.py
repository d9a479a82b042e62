import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy import lexicons as L
from colloquy.functions import text as T
from colloquy.functions.tokens import segment, tagged, tokens
from colloquy.operators import keywords, sentences
from colloquy.operators.sentiment import from_model_score, sentiment
from colloquy.plans import summary
from colloquy.queries import QUERIES


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'string'}" for n in names)).select(column.alias("x")).first()["x"]


def test_segmentation():
    known = {"会议", "讨论", "项目进度", "项目"}
    assert segment("会议讨论项目进度ok 12啊", known, 4) == ["会议", "讨论", "项目进度", "ok", " ", "12", "啊"]


def test_tokens_and_tags(spark):
    assert one(spark, tokens(F.col("t")), t="风险评估 ok") == ["风险", "评估", " ", "ok"]
    assert [(x["word"], x["tag"]) for x in one(spark, tagged(F.col("t"), {"风险": "n"}), t="风险x")] == [("风险", "n"), ("x", "eng")]
    assert one(spark, tokens(F.col("t")), t=None) == []


@pytest.mark.parametrize("text,out", [("  a　\n", "a"), (" x y\t", "x y"), ("", "")])
def test_strip(spark, text, out):
    assert one(spark, T.strip(F.col("t")), t=text) == out


def test_small_functions(spark):
    assert one(spark, T.count_of(F.col("t"), "aa"), t="aaaaa") == 2
    assert one(spark, T.token_jaccard(F.col("a"), F.col("b")), a=["ab", "c", "de"], b=["de", "fg"]) == pytest.approx(1 / 3)
    assert one(spark, T.overlap_share(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["x", "z"]) == 0.5
    assert one(spark, T.difference(F.col("a"), F.col("b")), a=["p", "q", "p"], b=["q"]) == ["p", "p"]
    assert one(spark, T.signature(F.col("a")), a=["会议", "的", "讨论"]) == "".join(sorted(["会议", "讨论"]))
    assert one(spark, T.clock(F.lit(75.9)), t="") == "01:15.000"
    assert one(spark, T.flag(F.col("t")), t="TRUE") is True and one(spark, T.flag(F.col("t")), t=None) is False
    assert one(spark, T.convert_script(F.col("t"), {"會": "会", "議": "议"}), t="會議") == "会议"
    assert one(spark, T.action_items(F.col("t")), t="我们需要完成报告。好的！") == ["需要完成报告"]
    assert one(spark, T.punctuated(F.col("t")), t="今天 开会") == "今天，开会。"
    assert one(spark, T.invented(F.col("s"), F.col("t"), F.col("a"), F.col("b")), s="记者报道", t="会议", a=[], b=[]) is True
    assert one(spark, T.poor(F.col("s"), F.col("a")), s="好好好好好", a=["好"]) is True
    assert one(spark, T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), t="") == 0.0


def mirror(words):
    p = n = 0.0
    i = 0
    while i < len(words):
        w = words[i]
        if w in L.NEUTRAL_WORDS:
            i += 1
            continue
        by, turned = 1.0, False
        if w in L.DEGREE_WORDS:
            by = L.DEGREE_WORDS[w]
            i += 1
            if i == len(words):
                break
            w = words[i]
        if w in L.NEGATION_WORDS:
            turned = True
            i += 1
            if i == len(words):
                break
            w = words[i]
        v = L.POSITIVE_WORDS.get(w, 0) * by or -L.NEGATIVE_WORDS.get(w, 0) * by
        if (v > 0) != turned:
            p += abs(v)
        else:
            n += abs(v)
        i += 1
    return round(p, 2), round(n, 2)


def test_sentiment_fold_against_a_loop(spark):
    dice = random.Random(1)
    pool = [*dice.sample(list(L.POSITIVE_WORDS), 4), *dice.sample(list(L.NEGATIVE_WORDS), 4), "规范", "风险", "不", "没", "很", "非常", "x"]
    rows = [(i, [dice.choice(pool) for _ in range(dice.randint(0, 9))]) for i in range(200)]
    out = spark.createDataFrame(rows, "i int, t array<string>").select("i", sentiment(F.col("t")).alias("s")).collect()
    assert {r["i"]: (r["s"]["positive_score"], r["s"]["negative_score"]) for r in out} == {i: pytest.approx(mirror(t)) for i, t in rows}


def test_model_scores(spark):
    assert one(spark, from_model_score(F.lit(0.7)), t="")["sentiment"] == "positive"


def test_keywords_zh(spark):
    text = "项目进度需要跟进。项目预算要控制！\n客户反馈意见"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "的 是 在")], "id int, text string").withColumn("tagged", tagged(F.col("text")))
    out = keywords.keywords_zh(rows, "id").collect()
    assert {r["id"] for r in out} == {1} and out[0]["word"] == "项目" and out[0]["frequency"] == 2
    assert [r["score"] for r in out] == sorted((r["score"] for r in out), reverse=True)


def test_topics_of_the_fixture(spark):
    found = one(spark, keywords.keyword_topics(F.col("t")), t="本次会议讨论项目进度安排，汇报工作完成情况，收集团队意见反馈。")
    assert len(found) == 5 and found[0]["score"] >= found[-1]["score"]


def test_sentences(spark):
    assert one(spark, sentences.sentences(F.col("t")), t="第一句话很长很长。第二句话很长很长！第三句话很长很长？第四句话很长很长。第五句话很长很长。") == ["第一句话很长很长", "第二句话很长很长", "第三句话很长很长", "第四句话很长很长", "第五句话很长很长"]
    long = "我们今天把所有的材料都看了一遍然后大家都说了自己的想法" * 4
    cut = one(spark, sentences.sentences(F.col("t")), t=long)
    assert len(cut) >= 3 and all(len(x) > 8 for x in cut)
    assert one(spark, sentences.sentences(F.col("t")), t="  ") == [] and one(spark, sentences.sentences(F.col("t")), t="短") == ["短"]


def test_ranking_prefers_what_others_share():
    words = [["a", "b"], ["a", "c"], ["a", "d"], ["x", "y"]]
    scores = sentences.text_rank(words)
    assert scores[3] == pytest.approx(0.15 / 4) and min(scores[:3]) > scores[3]
    assert sentences.ranked(list("pqrs"), words, {"x"}, 4) == [0, 1, 2, 3] and len(sentences.ranked(list("pqrs"), words, set(), 2)) == 2


def test_repeats_are_suppressed_in_order(spark):
    near = lambda x, y: F.substring(x, 1, 1) == F.substring(y, 1, 1)
    assert one(spark, sentences.suppress_repeats(F.col("a"), near, 2), a=["ax", "ay", "bx", "cx"]) == ["ax", "bx"]


def test_core_points(spark):
    rows = spark.createDataFrame([(1, ["大家必须在下周之前完成全部的合规培训工作", "大家必须在下周之前完成全部的合规培训工作吧", "散会"])], "id int, sentences array<string>")
    out = summary.core_points(rows, "id", F.array(F.lit("培训"))).first()["points"]
    assert out == ["参会人员必须在下周之前完成全部的合规培训工作"]


def test_fitted(spark):
    assert one(spark, summary.fitted(F.col("t"), 10), t="一二三四五六。七八九十一二") == "一二三四五六。"
    assert one(spark, summary.fitted(F.col("t"), 10), t="一二三四五六七八九十一二") == "一二三四五六七..."
    assert one(spark, summary.fitted(F.col("t"), 20), t="一二三四五六七") == "一二三四五六七。"


def test_white_space_at_ends_needs_no_regular_expression(spark):
    from colloquy.operators.sentences import sentences

    white = [chr(c) for c in range(0x3001) if re.match(r"\s", chr(c)) and not 0x1C <= c <= 0x1F]
    df = spark.createDataFrame([(w + " a" + w + "b" + w + "\n",) for w in white] + [("",), (None,), ("".join(white),)], "t string")
    assert all(r["s"] == (None if r["t"] is None else r["t"].strip()) for r in df.select("t", T.strip(F.col("t")).alias("s")).collect())
    assert "(?U)" not in df.select(sentences(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_cut_once_and_as_by_expressions(spark):
    """No set of signs is tried twice on a text, which one Arrow step sees to; pieces are those of the regular expressions."""
    dice = random.Random(9)
    made = lambda: "".join(dice.choice(["word ", "词", "。", "！", "?", "；", ",", "\n", " ", "\u3000", "abcdefg", "\x1c"]) for _ in range(dice.randint(0, 60)))
    df = spark.createDataFrame([(i, made()) for i in range(300)] + [(300, None), (301, "")], "id int, t string")
    flat = F.replace(T.strip(F.col("t")), F.lit("\n"), F.lit("。"))
    cuts = [F.when(F.size(T.pieces(flat, p, 5)) >= 5, F.struct(F.lit(k).alias("level"), T.pieces(flat, p, 5).alias("sentences"))) for k, p in enumerate(sentences.LEVELS)]
    told = df.select("id", F.coalesce(*cuts).alias("want"), sentences.leveled_sentences(F.col("t")).alias("found"), sentences.sentences(F.col("t")).alias("alone")).collect()
    assert all(r["found"]["sentences"] == r["alone"] and (r["found"] == r["want"] if r["want"] else r["found"]["level"] == 3) for r in told)
    assert {r["found"]["level"] for r in told} == {0, 1, 2, 3}
    plan = QUERIES["smart_sentences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "split(" not in plan


def test_words_and_their_sentences_on_a_texts_own_row(spark):
    """As by search of every sentence for every word, long runs of letters, too; the query joins and shuffles nothing."""
    dice = random.Random(4)
    made = lambda: "".join(dice.choice(["planet ", "plane", "planets. ", "explanet", "anet", "é", "!", "\n ", " ", "?", "x" * 30 + "planet" * 3, "lanet "]) for _ in range(dice.randint(0, 40)))
    df = spark.createDataFrame([(i, made()) for i in range(200)] + [(200, None), (201, ""), (202, " . . ")], "id int, t string")
    for r in df.select("t", keywords.sentence_counts(F.col("t")).alias("c")).collect():
        own = [s for s in re.split("[.!?\n]", r["t"] or "") if s.strip(" ")]
        every = [w for w in re.split("[^a-z]+", " ".join(own)) if len(w) > 4]
        want = {(w, every.count(w), sum(w in s for s in own)) for w in every}
        assert (r["c"]["sentences"], r["c"]["total"], {tuple(w) for w in r["c"]["words"]}) == (len(own), len(every), want)
    plan = QUERIES["tfidf_sentence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_best_english_words_are_those_of_the_table(spark):
    """In their order, with signs and white space of any kind; the query that ranks sentences by them joins and shuffles nothing."""
    dice = random.Random(8)
    made = lambda: "".join(dice.choice(["Red", "green", "blue", "the", "été", "x²y", "ab", "a\u0301bc", "don't"]) + dice.choice([" ", "\u3000", "\x1c", ", ", "\n", "\x85"]) for _ in range(dice.randint(0, 40)))
    df = spark.createDataFrame([(i, made()) for i in range(150)] + [(150, None), (151, "")], "id int, text string")
    want = {}
    for r in keywords.keywords_en(df, "id", n=4).orderBy("id", "rank").collect():
        want.setdefault(r["id"], []).append(r["word"])
    assert {r["id"]: r["w"] for r in df.select("id", keywords.best_words_en(F.col("text"), 4).alias("w")).collect()} == {i: want.get(i, []) for i in range(152)}
    plan = QUERIES["textrank_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
