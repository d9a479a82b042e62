"""The library's own queries by name, each over whole test tables or over rows that are given here, and their SQL.

conversations stand for segments, documents for texts, events for a stream of chunks, embeddings for vectors of
sentences and frames, and the order tables for the relational core.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lexicons as L
from .functions import rules as R
from .functions import text as T
from .functions.tokens import tokens as zh_tokens
from .operators import compliance, keywords, sentences, sentiment, timeline
from .plans import analyze, reports, summary
from .sources import store
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


# ---- the relational core


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10 OFFSET 20")
def meetings_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of ten of one status."""
    own = store.where_given(read(spark, d, "orders"), o_orderstatus="F", o_orderpriority=None)
    return store.page(own, 3, 10, "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))


@query("SELECT o_orderkey, count(l_orderkey) AS n, coalesce(string_agg(l_linenumber::VARCHAR || ':' || l_returnflag, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag), '') AS lines, min(l_linenumber) AS first FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def meeting_detail(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its lines in order, joined to one text: lines are gathered before the join."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("s"), F.min("l_linenumber").alias("first")
    )
    text = F.array_join(F.transform("s", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_returnflag"])), " ")
    both = read(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(text, F.lit("")).alias("lines"), "first")


@query("SELECT doc_id, source, n_chars FROM documents WHERE text ILIKE '%ation the%' OR source ILIKE '%ation the%'")
def knowledge_search(spark: SparkSession, d: str) -> DataFrame:
    return store.search(read(spark, d, "documents"), "ation the", "text", "source").select("doc_id", "source", "n_chars")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_anti_points(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders but none of one status."""
    orders = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    own = read(spark, d, "customer").join(orders.select("c_custkey"), "c_custkey", "left_semi")
    return own.join(orders.where("o_orderstatus = 'P'").select("c_custkey"), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 2)) UNION ALL SELECT n_nationkey, n_name, 9 FROM nation WHERE n_nationkey IN (1, 2) UNION ALL VALUES (99, 'NEWLAND', 3)")
def upsert_weights(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation")
    new = nation.where("n_nationkey in (1, 2)").withColumn("n_regionkey", F.lit(9)).unionByName(spark.createDataFrame([(99, "NEWLAND", 3)], "n_nationkey int, n_name string, n_regionkey int"))
    return store.upserted(nation, new, "n_name")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'renamed' ELSE s_name END AS s_name, round(CASE WHEN s_suppkey % 7 = 0 AND s_suppkey % 2 = 0 THEN 0 ELSE s_acctbal END, 2) AS s_acctbal FROM supplier")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    """Only the values that a patch has change."""
    s = read(spark, d, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))
    patch = s.where("s_suppkey % 7 = 0").select("s_suppkey", F.lit("renamed").alias("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(0.0)).alias("s_acctbal"))
    return store.patched(s, patch, "s_suppkey")


@query("SELECT doc_id, CASE WHEN quality <> 0 THEN quality END AS shown, coalesce(toxic, 0) AS toxic FROM labels")
def falsy_projection(spark: SparkSession, d: str) -> DataFrame:
    """A score of 0 is shown as none, a missing number as 0."""
    return read(spark, d, "labels").select("doc_id", F.when(F.col("quality") != 0, F.col("quality")).alias("shown"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_projection(spark: SparkSession, d: str) -> DataFrame:
    return store.decoded_lists(read(spark, d, "events"), props="struct<k: bigint>").select("event_id", "props.k")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 20")
def page_limit_desc(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy(F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_partkey"), F.desc("l_suppkey")).limit(20)


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_order, count(*) AS n FROM orders GROUP BY o_custkey")
def first_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer the first order, and how many there are."""
    orders = read(spark, d, "orders").select("o_custkey", "o_orderkey")
    first = store.first_by(orders, "o_custkey", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("first_order"))
    return first.join(orders.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey")


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def equi_joins(spark: SparkSession, d: str) -> DataFrame:
    """Counts by nation, aggregated before the names are joined on."""
    c = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    names = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "customers", "balance")


# ---- participation, levels and trends


@query("SELECT conv_id, count(DISTINCT coalesce(role, 'unknown')) AS participants FROM conversations GROUP BY conv_id")
def participants(spark: SparkSession, d: str) -> DataFrame:
    return timeline.participants(read(spark, d, "conversations").withColumnRenamed("role", "speaker"), "conv_id")


@query("SELECT conv_id, role AS speaker, sum(length(text))::BIGINT AS duration, count(*) AS count, round(100.0 * sum(length(text)) / sum(sum(length(text))) OVER (PARTITION BY conv_id), 6) AS percentage FROM conversations GROUP BY conv_id, role")
def participation_share(spark: SparkSession, d: str) -> DataFrame:
    """How much each role says in each conversation, in characters."""
    out = timeline.participation(read(spark, d, "conversations").withColumnRenamed("role", "speaker"), "conv_id", F.length("text").cast("long"))
    return out.withColumn("percentage", F.round("percentage", 6))


@query("SELECT CASE WHEN s >= 90 THEN '优秀' WHEN s >= 75 THEN '良好' WHEN s >= 60 THEN '合格' ELSE '不合格' END AS level, count(*) AS n FROM (SELECT (c_acctbal + 1000) / 110 AS s FROM customer) GROUP BY 1")
def score_level_hist(spark: SparkSession, d: str) -> DataFrame:
    return reports.level_histogram(read(spark, d, "customer"), (F.col("c_acctbal") + 1000) / 110)


_TREND = """
WITH m AS (SELECT o_orderdate AS date, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice / 5000 END AS score, o_custkey AS duration, (o_orderkey % 4)::INT AS r, (o_orderkey % 3)::INT AS k FROM orders WHERE o_orderstatus = 'F'),
t AS (SELECT count(*) AS total, round_even(avg(score), 2) AS avg_score, round_even(avg(duration), 0) AS avg_duration, sum(r)::BIGINT AS total_risks, sum(k)::BIGINT AS total_missing,
  count(*) FILTER (score >= 90) AS excellent, count(*) FILTER (score >= 75 AND score < 90) AS good, count(*) FILTER (score >= 60 AND score < 75) AS pass, count(*) FILTER (score < 60) AS fail,
  epoch_us(min(date)) AS first_date, epoch_us(max(date)) AS last_date FROM m)
SELECT *, CASE WHEN avg_score < 60 THEN '整体合规评分偏低，建议加强合规培训;' WHEN avg_score < 80 THEN '合规评分有提升空间，建议优化传达流程;' ELSE '' END
  || CASE WHEN total_risks > 5 THEN '风险内容较多，建议加强风险预警监控;' ELSE '' END || CASE WHEN total_missing > 10 THEN '必传要点覆盖不足，建议完善知识库内容;' ELSE '' END AS recommendations FROM t
"""


@query(_TREND)
def compliance_trend(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 5000)
    some = lambda n: F.array_repeat(F.lit("x"), (F.col("o_orderkey") % n).cast("int"))
    m = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderdate").alias("date"), score.alias("score"), F.col("o_custkey").alias("duration"), some(4).alias("risks"), some(3).alias("missing"))
    m = m.withColumn("level", T.score_level(F.coalesce("score", F.lit(0.0))))
    said = F.array_join(F.transform("recommendations", lambda x: F.concat(x, F.lit(";"))), "")
    return reports.trend(m).withColumns({"recommendations": said, "first_date": micros("first_date"), "last_date": micros("last_date")})


@query("SELECT date, score, level FROM (VALUES ('2024-01-01', 95.0::DOUBLE, '优秀'), ('2024-01-02', 80.0, '良好'), ('2024-01-03', 0.0, '')) t(date, score, level)")
def trend_points(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("2024-01-02", 80.0, "良好"), ("2024-01-01", 95.0, "优秀"), ("2024-01-03", None, None)], "date string, score double, level string")
    return reports.trend_points(rows)


@query("SELECT * FROM (VALUES (1, '整体合规评分偏低，建议加强合规培训'), (2, '合规评分有提升空间，建议优化传达流程|风险内容较多，建议加强风险预警监控'), (3, '必传要点覆盖不足，建议完善知识库内容'), (4, '整体合规情况良好，继续保持')) t(id, said)")
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 58.33, 0, 0), (2, 79.9, 6, 10), (3, 80.0, 5, 11), (4, 95.0, 0, 0)], "id int, a double, r int, m int")
    return rows.select("id", F.array_join(reports.recommendations(F.col("a"), F.col("r"), F.col("m")), "|").alias("said"))


# ---- words


_STOP = ", ".join(f"'{w}'" for w in L.STOP_WORDS_EN)
_TERMS = f"""
w AS (SELECT doc_id, unnest(x) AS word, unnest(range(len(x))) AS pos FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda x: length(x) > 2 AND x NOT IN ({_STOP})) AS x FROM documents WHERE lang = 'en')),
c AS (SELECT doc_id, word, count(*) AS frequency, min(pos) AS first FROM w GROUP BY doc_id, word),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, first) AS rank, sum(frequency) OVER (PARTITION BY doc_id) AS total FROM c)
"""


@query(f"WITH {_TERMS} SELECT doc_id, rank, word, frequency, round(frequency / total, 6) AS score FROM r WHERE rank <= 10")
def keywords_en(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("lang = 'en'").select("doc_id", "text")
    return keywords.keywords_en(docs, "doc_id").withColumn("score", F.round("score", 6))


_DF_WORDS = ["the", "of", "ation", "que", "und", "los", "tion", "license", "http", "zzz"]


@query(f"SELECT word, count(*) AS documents FROM documents, (SELECT unnest({_DF_WORDS}) AS word) WHERE contains(text, word) GROUP BY word")
def keyword_df(spark: SparkSession, d: str) -> DataFrame:
    """How many documents contain each word of a lexicon, anywhere in them."""
    return keywords.document_frequency(read(spark, d, "documents"), _DF_WORDS, "doc_id")


@query(
    """WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents WHERE lang = 'en'),
w AS (SELECT doc_id, s, unnest(regexp_split_to_array(lower(array_to_string(s, ' ')), '[^a-z]+')) AS word FROM s),
c AS (SELECT doc_id, word, count(*) AS f, any_value(s) AS s FROM w WHERE length(word) > 4 GROUP BY doc_id, word)
SELECT doc_id, word, f AS frequency, round(f / sum(f) OVER (PARTITION BY doc_id) * (ln((len(s) + 1) / (len(list_filter(s, lambda x: contains(lower(x), word))) + 1)) + 1), 6) AS score FROM c"""
)
def tfidf_sentence(spark: SparkSession, d: str) -> DataFrame:
    """Frequency times rarity among a document's own sentences, for words of five letters or more."""
    docs = read(spark, d, "documents").where("lang = 'en'")
    own = docs.select("doc_id", keywords.sentence_counts(F.lower("text")).alias("c")).select("doc_id", "c.sentences", "c.total", F.explode("c.words").alias("w"))
    idf = F.ln((F.col("sentences") + 1) / (F.col("w.inside") + 1)) + 1
    return own.select("doc_id", "w.word", "w.frequency", F.round(F.col("w.frequency") / F.col("total") * idf, 6).alias("score"))


@query("""SELECT doc_id, i, s AS sentence FROM (SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 10) AS x FROM documents))""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.posexplode(sentences.plain_sentences(F.col("text"), "en")).alias("i", "sentence"))


_EDGE_WORDS = """
w AS (SELECT conv_id, turn AS i, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM conversations),
k AS (SELECT * FROM w WHERE length(word) > 3),
n AS (SELECT conv_id, i, count(*) AS n FROM k GROUP BY conv_id, i),
u AS (SELECT DISTINCT conv_id, i, word FROM k),
e AS (SELECT a.conv_id, a.i, b.i AS j, count(*) AS c FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.word = b.word AND a.i < b.i GROUP BY 1, 2, 3)
"""


def _turn_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(T.words(F.col("text")), lambda w: F.length(w) > 3)
    return read(spark, d, "conversations").select("conv_id", F.col("turn").alias("i"), F.explode(words).alias("word"))


@query(f"WITH {_EDGE_WORDS} SELECT e.conv_id, e.i, e.j, round(c / least(x.n, y.n), 6) AS w FROM e JOIN n x ON x.conv_id = e.conv_id AND x.i = e.i JOIN n y ON y.conv_id = e.conv_id AND y.i = e.j")
def textrank_edges(spark: SparkSession, d: str) -> DataFrame:
    return sentences.shared_word_edges(_turn_words(spark, d), "conv_id").withColumn("w", F.round("w", 6))


@query()
def textrank_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best sentences of each English document."""
    docs = read(spark, d, "documents").where("lang = 'en'")
    rows = docs.select("doc_id", sentences.plain_sentences(F.col("text"), "en").alias("sentences"), keywords.best_words_en(F.col("text"), 20).alias("keywords"))
    best = sentences.key_sentences(rows, "doc_id", 5, tokenize=str.split)
    return best.select("doc_id", F.posexplode("key_sentences").alias("i", "sentence"))


_EN_TOPICS = {"report": ["the", "ation", "ing"], "plan": ["to", "er", "est"], "risk": ["of", "ble", "re"], "people": ["ed", "was", "and"], "money": ["is", "only", "from"], "market": ["que", "und", "con"]}


def _topic_sql(table: str, key: str, topics: dict[str, list[str]]) -> str:
    one = []
    for k, (name, ws) in enumerate(topics.items()):
        found = " + ".join(f"contains(text, '{w}')::BIGINT" for w in ws)
        total = " + ".join(f"((length(text) - length(replace(text, '{w}', ''))) / {len(w)})::BIGINT" for w in ws)
        one.append(f"SELECT {key}, {k} AS place, '{name}' AS topic, {found} AS keyword_hits, {total} AS total_hits, length(text) AS n FROM {table}")
    body = " UNION ALL ".join(one)
    lens = " ".join(f"WHEN '{n}' THEN {len(ws)}" for n, ws in topics.items())
    return (
        f"SELECT {key}, rank, topic, round_even(score, 4) AS score, keyword_hits, total_hits FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, place) AS rank FROM ("
        f"SELECT *, keyword_hits / CASE topic {lens} END * 0.6::DOUBLE + least(total_hits / greatest(n / 100, 1.0::DOUBLE), 1.0::DOUBLE) * 0.4::DOUBLE AS score FROM ({body}))) WHERE rank <= 5"
    )


def _topics(rows: DataFrame, key: str, words: dict[str, list[str]]) -> DataFrame:
    at = rows.select(key, F.posexplode(keywords.keyword_topics(F.col("text"), None, words)).alias("i", "t"))
    return at.select(key, (F.col("i") + 1).alias("rank"), "t.*")


@query(f"SELECT doc_id, rank, topic, keyword_hits, total_hits FROM ({_topic_sql('documents', 'doc_id', _EN_TOPICS)})")
def topic_keyword(spark: SparkSession, d: str) -> DataFrame:
    """The order tells the scores; as numbers they may fall on a rounding tie, on which engines differ."""
    return _topics(read(spark, d, "documents"), "doc_id", _EN_TOPICS).drop("score")


_TOPIC_TEXT = "本次会议讨论项目进度安排，汇报工作完成情况，收集团队意见反馈。"


@query(_topic_sql(f"(SELECT 1 AS id, '{_TOPIC_TEXT}' AS text)", "id", L.TOPICS))
def topic_zh_fixture(spark: SparkSession, d: str) -> DataFrame:
    return _topics(spark.createDataFrame([(1, _TOPIC_TEXT)], "id int, text string"), "id", L.TOPICS)


_CENTRES = """c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
v AS (SELECT label, list(m ORDER BY i) AS centre FROM c GROUP BY label),
s AS (SELECT vec_id, v.label, list_cosine_similarity(embedding::DOUBLE[], centre) AS sim FROM embeddings, v)"""


def _similarities(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, sim): each vector against each label's mean vector, of which there are as many as labels."""
    e = read(spark, d, "embeddings")
    flat = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centre"))
    every = centres.agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("centres"))
    at = e.select("vec_id", "embedding").crossJoin(F.broadcast(every))  # one row of one small array
    return at.select("vec_id", F.explode(F.transform("centres", lambda c: F.struct(c["label"].alias("label"), T.cosine(F.col("embedding"), c["centre"]).alias("sim")))).alias("s")).select("vec_id", "s.label", "s.sim")


@query(f"WITH {_CENTRES} SELECT vec_id, label, round(0.7 * sim + 0.3 * (label % 3) / 2, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY 0.7 * sim + 0.3 * (label % 3) / 2 DESC, label) <= 5")
def topic_semantic(spark: SparkSession, d: str) -> DataFrame:
    """0.7 of a similarity and 0.3 of a share of words, best five."""
    score = F.col("sim") * 0.7 + F.col("label") % 3 * 0.3 / 2
    best = keywords.top(_similarities(spark, d).withColumn("s", score), "vec_id", 5, F.desc("s"), F.asc("label"))
    return best.select("vec_id", "label", F.round("s", 6).alias("score"))


@query(f"WITH {_CENTRES} SELECT vec_id, label AS policy, round(sim * 40, 6) AS component FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) = 1")
def semantic_policy_best(spark: SparkSession, d: str) -> DataFrame:
    best = _similarities(spark, d).groupBy("vec_id").agg(F.min(F.struct((-F.col("sim")).alias("o"), "label")).alias("b"))
    return best.select("vec_id", F.col("b.label").alias("policy"), F.round(-F.col("b.o") * 40, 6).alias("component"))


@query(
    """WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 1)) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END, 6) AS similarity
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
)
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn against the next of its conversation."""
    t = read(spark, d, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.token_jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


# ---- sentiment, risks and compliance


@query("SELECT * FROM (VALUES (1, 'positive', 1.0, 1.5, 0.0), (2, 'negative', 0.0, 0.0, 2.0), (3, 'neutral', 0.5, 0.0, 0.0), (4, 'positive', 1.0, 1.2, 0.0), (5, 'neutral', 0.5, 0.0, 0.0), (6, 'negative', 0.0, 0.0, 3.0), (7, 'positive', 1.0, 1.0, 0.0)) t(id, sentiment, score, positive_score, negative_score)")
def sentiment_fold(spark: SparkSession, d: str) -> DataFrame:
    cases = [["非常", "顺利"], ["不", "满意"], ["规范"], ["很", "规范"], [], ["非常", "不", "满意"], ["不", "抱怨"]]
    rows = spark.createDataFrame([(k + 1, c) for k, c in enumerate(cases)], "id int, tokens array<string>")
    out = rows.select("id", sentiment.sentiment(F.col("tokens")).alias("s")).select("id", "s.*")
    return out.select("id", "sentiment", *[F.col(c).cast("decimal(3,1)").alias(c) for c in ("score", "positive_score", "negative_score")])


@query("SELECT doc_id, instr(text, 'tion') AS at, (instr(text, 'tion') > 0 AND contains(substring(text, greatest(1, instr(text, 'tion') - 30), least(30, instr(text, 'tion') - 1)), 'the')) AS after_the FROM documents")
def negation_window(spark: SparkSession, d: str) -> DataFrame:
    """Whether a word is among the 30 characters before the first place of another."""
    at = F.instr("text", F.lit("tion"))
    before = F.substring(F.col("text"), F.greatest(F.lit(1), at - 30), F.least(F.lit(30), at - 1))
    return read(spark, d, "documents").select("doc_id", at.alias("at"), ((at > 0) & F.contains(before, F.lit("the"))).alias("after_the"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false)) t(id, negated)")
def negation_fixture(spark: SparkSession, d: str) -> DataFrame:
    cases = [("我们禁止承诺保本保收益", "保本"), ("可以承诺保本保收益", "保本"), ("大家好", "保本"), ("禁止" + "好" * 31 + "保本", "保本")]
    return spark.createDataFrame([(k + 1, *c) for k, c in enumerate(cases)], "id int, t string, k string").select("id", T.negated(F.col("t"), F.col("k")).alias("negated"))


@query("SELECT * FROM (VALUES ('反对意见', 'high'), ('抱怨', 'medium'), ('保本', 'low')) t(keyword, severity)")
def severity(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("反对意见",), ("抱怨",), ("保本",)], "keyword string").select("keyword", T.severity(F.col("keyword")).alias("severity"))


_EN_RISKS = ["thereat", "only", "ation", "que", "worthless"]


@query(f"SELECT conv_id, turn, k AS keyword FROM conversations, (SELECT unnest({_EN_RISKS}) AS k) WHERE contains(lower(text), k)")
def risk_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Each keyword that a turn contains: a filter of a small array, so that no join is made."""
    found = F.filter(F.array(*map(F.lit, _EN_RISKS)), lambda k: F.contains(F.lower("text"), k))
    return read(spark, d, "conversations").select("conv_id", "turn", F.explode(found).alias("keyword"))


@query(f"SELECT conv_id, k AS keyword, min(turn) AS first, count(*) AS n FROM conversations, (SELECT unnest({_EN_RISKS}) AS k) WHERE contains(lower(text), k) GROUP BY conv_id, k")
def risk_markers_first_all(spark: SparkSession, d: str) -> DataFrame:
    """The first turn with each keyword, and how many have it."""
    return risk_keywords(spark, d).groupBy("conv_id", "keyword").agg(F.min("turn").alias("first"), F.count("*").alias("n"))


@query("WITH m AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, 'tion[a-z]+|ation')) AS keyword FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM m GROUP BY conv_id) SELECT m.conv_id, m.turn, m.keyword, n.n * count(*) AS rows FROM m JOIN n ON m.conv_id = n.conv_id GROUP BY m.conv_id, m.turn, m.keyword, n.n")
def semantic_risks(spark: SparkSession, d: str) -> DataFrame:
    """Every match of a rule in a turn, once for each match in the whole conversation: counted, not written out."""
    m = read(spark, d, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("tion[a-z]+|ation"), F.lit(0))).alias("keyword"))
    own = m.groupBy("conv_id", "turn", "keyword").agg(F.count("*").alias("c"))
    return own.withColumn("n", F.sum("c").over(Window.partitionBy("conv_id"))).select("conv_id", "turn", "keyword", (F.col("c") * F.col("n")).alias("rows"))


_ITEMS = [
    compliance.Item("风险告知要求", "必须告知风险", "points", ["风险", "告知", "收益"], ["风险告知", "收益说明"]),
    compliance.Item("禁止承诺", "不得承诺收益", "risk", ["保本", "保收益", "承诺"], []),
]
_RISKY = "理财产品可以保本保收益，风险请告知。"


def _score_rows(spark: SparkSession) -> DataFrame:
    schema = f"id int, text string, segments {compliance.SEGMENTS}"
    rows = [(1, _RISKY, None), (2, _RISKY, [(_RISKY[:12], 0.0, 2.0), (_RISKY[12:], 2.0, 4.0)]), (3, "", []), (4, None, None), (5, "我们禁止保本保收益，并告知风险。", None)]
    return compliance.score(spark.createDataFrame(rows, schema), _ITEMS, tokens=zh_tokens)


@query("SELECT * FROM (VALUES (1, 45.33, '不合格', '保本,保收益', '', 5, 1), (2, 45.33, '不合格', '保本,保收益', '', 5, 3), (3, 20.0, '不合格', '', '', 0, 0), (4, 20.0, '不合格', '', '', 0, 0), (5, 58.33, '不合格', '', '', 5, 0)) t(id, total, level, risks, missing, matched, markers)")
def compliance_total(spark: SparkSession, d: str) -> DataFrame:
    out = _score_rows(spark)
    return out.select(
        "id", F.col("total_score").cast("decimal(5,2)").alias("total"), F.col("score_level").alias("level"), F.array_join("risk_keywords", ",").alias("risks"), F.array_join("missing_points", ",").alias("missing"), F.size("matched_keywords").alias("matched"), F.size("risk_time_markers").alias("markers")
    )


@query("SELECT * FROM (VALUES (1, 30.0, '风险告知,收益说明'), (2, 30.0, '风险告知,收益说明'), (3, 0.0, ''), (4, 0.0, ''), (5, 30.0, '风险告知,收益说明')) t(id, coverage, covered)")
def point_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _score_rows(spark).select("id", F.col("components.point_coverage").cast("decimal(4,1)").alias("coverage"), F.array_join("covered_points", ",").alias("covered"))


@query("SELECT conv_id, turn, contains(lower(text), 'only') OR contains(lower(text), 'worthless') AS has_risk, contains(lower(text), 'only')::INT + contains(lower(text), 'worthless')::INT AS risks, contains(lower(text), 'ation')::INT * 2 AS covered FROM conversations")
def realtime_check(spark: SparkSession, d: str) -> DataFrame:
    """Each turn checked by itself against a small knowledge base."""
    items = [compliance.Item("r", "", "risk", ["only", "worthless"]), compliance.Item("p", "", "points", ["ation"], ["a", "b"])]
    out = compliance.live_check(read(spark, d, "conversations"), items)
    return out.select("conv_id", "turn", "has_risk", F.size("risk_items").alias("risks"), F.size("covered").alias("covered"))


# ---- timelines


_SPANS = "(SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1)::INT AS idx, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 100 AS e, event_type FROM events WHERE event_type IN ('click', 'view'))"


@query(f"SELECT event_id, coalesce(arg_min(p.event_type, p.idx), 'SPEAKER_00') AS speaker FROM (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'error') q LEFT JOIN {_SPANS} p ON p.user_id = q.user_id AND t BETWEEN p.s AND p.e GROUP BY event_id")
def speaker_assign(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("t", micros("ts") / 1e6)
    spans = e.where("event_type in ('click', 'view')").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1).alias("idx"), F.col("t").alias("start"), (F.col("t") + F.col("value") * 100).alias("end"), F.col("event_type").alias("speaker"))
    own = e.where("event_type = 'error'").select("event_id", "user_id", F.col("t").alias("start_time"))
    return timeline.assign_speakers(own, spans, "user_id", bin_seconds=3600.0).select("event_id", "speaker")


@query(
    """WITH f AS (SELECT user_id, ts, event_type, row_number() OVER w AS n, coalesce(event_type <> lag(event_type) OVER w, false)::INT AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::INT AS run FROM f)
SELECT user_id, run AS idx, min(n)::INT AS start, max(n)::INT AS "end", any_value(event_type) AS speaker FROM r GROUP BY user_id, run"""
)
def segments_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal event types of each user, in order of time."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))
    e = read(spark, d, "events").select("user_id", (n - 1).alias("idx"), n.alias("start"), n.alias("end"), F.col("event_type").alias("speaker"))
    return timeline.merge_same(e, "user_id")


@query("SELECT * FROM (VALUES (0, 0.00, 0.06, 'SPEAKER_00'), (1, 0.06, 0.13, 'SPEAKER_01'), (2, 0.13, 0.16, 'SPEAKER_00')) t(idx, start, \"end\", speaker)")
def label_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, i, x, 0.16) for i, x in enumerate([0, 0, 1, 1, 0])], "m int, i int, label int, duration double")
    out = timeline.label_segments(rows, "m")
    return out.select("idx", F.col("start").cast("decimal(4,2)").alias("start"), F.col("end").cast("decimal(4,2)").alias("end"), "speaker")


@query("SELECT * FROM (VALUES (1, 0, 0.0, 1.0, 'A'), (1, 1, 1.0, 1.1, 'B'), (1, 2, 1.1, 2.0, 'A'), (2, 0, 0.0, 1.0, 'A'), (2, 1, 1.0, 2.1, 'B')) t(m, idx, start, \"end\", speaker)")
def merge_short(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, 0, 0.0, 1.0, "A"), (1, 1, 1.0, 1.1, "B"), (1, 2, 1.1, 2.0, "A"), (2, 0, 0.0, 1.0, "A"), (2, 1, 1.0, 1.1, "B"), (2, 2, 1.1, 2.0, "A"), (2, 3, 2.0, 2.1, "B")]
    out = timeline.merged_short(spark.createDataFrame(rows, "m int, idx int, start double, end double, speaker string"), "m", 0.3)
    return out.select("m", "idx", F.col("start").cast("decimal(3,1)").alias("start"), F.col("end").cast("decimal(3,1)").alias("end"), "speaker")


@query("SELECT event_id, coalesce(lead(s) OVER w - e < 0.1, false) OR coalesce(s - lag(e) OVER w < 0.1, false) AS overlap FROM (SELECT event_id, user_id, ts, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 60 AS e FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def overlap_flag(spark: SparkSession, d: str) -> DataFrame:
    t = micros("ts") / 1e6
    e = read(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("idx"), t.alias("start"), (t + F.col("value") * 60).alias("end"))
    return timeline.flag_overlaps(e, "user_id").select("event_id", "overlap")


@query(
    """WITH f AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, CASE WHEN value > 20 THEN event_type END AS l FROM events),
p AS (SELECT *, CASE WHEN l IS NOT NULL THEN n END AS p FROM f),
q AS (SELECT *, last_value(p IGNORE NULLS) OVER a AS pl, first_value(p IGNORE NULLS) OVER b AS pr, last_value(l IGNORE NULLS) OVER a AS ll, first_value(l IGNORE NULLS) OVER b AS lr FROM p
  WINDOW a AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, coalesce(l, CASE WHEN pr IS NULL OR n - pl < pr - n THEN ll ELSE lr END) AS label FROM q"""
)
def fill_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "value", F.col("event_type").alias("label"))
    return timeline.fill_nearest(e, "user_id", "ts", "label", F.col("value") > 20).select("event_id", "label")


@query(
    """WITH f AS (SELECT user_id, epoch_us(ts) AS t, value > 15 AS loud, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT *, coalesce(loud <> lag(loud) OVER (PARTITION BY user_id ORDER BY n), false)::INT AS c FROM f),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY n) AS run FROM c)
SELECT user_id, min(t) AS start, max(t) AS "end" FROM r WHERE loud GROUP BY user_id, run HAVING max(t) - min(t) >= 3600000000"""
)
def vad_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of loud events that last an hour."""
    return timeline.voice_runs(read(spark, d, "events"), "user_id", "ts", F.col("value") > 15, micros("ts"), micros("ts"), 3_600_000_000)


@query("SELECT event_id, round(20 * log10(value / 1000 + 1e-10), 6) AS db, value / 1000 > 0.03 AS speech FROM events")
def level_meter(spark: SparkSession, d: str) -> DataFrame:
    m = timeline.level_meter(F.col("value") / 1000)
    return read(spark, d, "events").select("event_id", F.round(m["db"], 6).alias("db"), m["speech"].alias("speech"))


@query("SELECT user_id, quantile_cont(value, 0.2) AS p20, count(*) FILTER (value > p) AS above FROM (SELECT user_id, value, quantile_cont(value, 0.2) OVER (PARTITION BY user_id) AS p FROM events) GROUP BY user_id")
def percentile_mask(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each user are above the 20th percentile."""
    e = read(spark, d, "events").select("user_id", "value")
    p = e.groupBy("user_id").agg(F.percentile("value", F.lit(0.2)).alias("p20"))
    return e.join(p, "user_id").groupBy("user_id", "p20").agg(F.count_if(F.col("value") > F.col("p20")).alias("above")).select("user_id", "p20", "above")


@query("SELECT event_id, coalesce(sum(length(event_type)) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_chars FROM events")
def running_offset(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("n", F.length("event_type"))
    return timeline.running_offsets(e, "user_id", "ts", "n").select("event_id", F.col("offset").cast("long").alias("offset_chars"))


@query("SELECT * FROM (VALUES (0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1)) t(i, label)")
def median_smoothing(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([0, 0, 1, 0, 1, 1, 1])], "m int, i int, label int")
    return timeline.median_smoothed(rows, "m", "i", "label").select("i", "label")


# ---- streams


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (micros("ts") / 1e6).alias("at"), (F.col("value") / 500).alias("level"), F.lit(20.0).alias("seconds"))


@query()  # its SQL is in operator_queries
def meeting_detector(spark: SparkSession, d: str) -> DataFrame:
    return live.meetings_in(_chunks(spark, d))


@query()  # its SQL is in operator_queries
def buffer_flush(spark: SparkSession, d: str) -> DataFrame:
    return live.pieces_in(_chunks(spark, d), pause=40.0, longest=200.0).select("key", "start", "end", F.size("chunks").alias("n"))


@query(
    """WITH f AS (SELECT user_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000, false)::INT AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t) AS run FROM f)
SELECT user_id, min(t) AS start, max(t) + 1800000000 AS "end", count(*) AS n FROM r GROUP BY user_id, run"""
)
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return live.sessions(read(spark, d, "events"), "user_id", "30 minutes").withColumns({"start": micros("start"), "end": micros("end")})


@query(
    """SELECT start, start + 7200000000 AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
SELECT unnest([epoch_us(ts) // 3600000000 * 3600000000, epoch_us(ts) // 3600000000 * 3600000000 - 3600000000]) AS start, event_type, value FROM events) GROUP BY start, event_type"""
)
def tumbling_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two hours, every hour."""
    return live.tumbling(read(spark, d, "events"), "2 hours", "1 hour").withColumns({"start": micros("start"), "end": micros("end"), "total": F.round("total", 4)})


@query("SELECT user_id AS meeting_id, arg_max(event_type, ts) AS message FROM events GROUP BY user_id")
def progress(spark: SparkSession, d: str) -> DataFrame:
    log = read(spark, d, "events").select(F.col("user_id").alias("meeting_id"), F.col("ts").alias("at"), F.lit(0).alias("progress"), F.col("event_type").alias("message"))
    return live.progress(log).select("meeting_id", "message")


# ---- texts


@query(
    """WITH x AS (SELECT doc_id, list_concat(regexp_extract_all(text, 'need to[^.!?]*[.!?]'), list_concat(regexp_extract_all(text, 'th[a-z]*tion [^.!?]*[.!?]'), regexp_extract_all(text, 'only[^.!?]*[.!?]'))) AS x FROM documents),
c AS (SELECT doc_id, list_filter(list_transform(x, lambda s: trim(s, '。！？. ' || chr(10))), lambda s: length(s) > 5) AS c FROM x),
u AS (SELECT doc_id, list_filter(c, lambda s, i: list_position(c, s) = i)[1:5] AS u FROM c)
SELECT doc_id, unnest(range(len(u)))::INT AS i, unnest(u) AS item FROM u"""
)
def action_items(spark: SparkSession, d: str) -> DataFrame:
    found = T.action_items(F.col("text"), ["need to[^.!?]*[.!?]", "th[a-z]*tion [^.!?]*[.!?]", "only[^.!?]*[.!?]"])
    return read(spark, d, "documents").select("doc_id", F.posexplode(found).alias("i", "item"))


@query(
    """WITH s AS (SELECT doc_id, text, source, split_part(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), 1) AS f FROM documents)
SELECT doc_id, CASE WHEN length(f) <= 50 AND length(regexp_replace(f, '[^a-zA-Z0-9_-]', '', 'g')) >= 2 THEN regexp_replace(f, '[^a-zA-Z0-9_-]', '', 'g') ELSE source END AS title FROM s"""
)
def title_points_parse(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.title_of(F.col("text"), F.col("source")).alias("title"))


@query("SELECT * FROM (VALUES (1, '按时完成|提交周报|必须复核全部材料|结尾句子完整'), (2, '')) t(id, points)")
def policy_points(spark: SparkSession, d: str) -> DataFrame:
    text = "1、 按时完成\n- 提交周报\n短\n2. 按时完成\n必须复核全部材料。\n结尾句子完整；\n没有标记的一行文字"
    rows = spark.createDataFrame([(1, text), (2, "")], "id int, text string")
    return rows.select("id", F.array_join(T.required_points(F.col("text")), "|").alias("points"))


@query("SELECT doc_id, translate(text, 'àáâäçèéêëíîïñóôöùúûü', 'aaaaceeeeiiinooouuuu') AS plain FROM documents")
def script_convert(spark: SparkSession, d: str) -> DataFrame:
    table = dict(zip("àáâäçèéêëíîïñóôöùúûü", "aaaaceeeeiiinooouuuu"))
    return read(spark, d, "documents").select("doc_id", T.convert_script(F.col("text"), table).alias("plain"))


@query("SELECT * FROM (VALUES (1, '是好'), (2, '测试好'), (3, '会议讨论项目')) t(id, said)")
def repeat_collapse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "是是是是好"), (2, "测试测试测试好"), (3, "会议会议讨论项目")], "id int, t string")
    return rows.select("id", R.tidied(F.col("t")).alias("said"))


@query("SELECT * FROM (VALUES (1, '有观点认为需要加强培训'), (2, '会议讨论项目'), (3, '参会人员支持这个方案')) t(id, said)")
def narrative(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "大家好，我觉得需要加强培训"), (2, "今天我们讨论项目"), (3, "大家支持这个方案")], "id int, t string")
    return rows.select("id", R.narrated(F.col("t")).alias("said"))


@query()
def transcript_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "今天 我们讨论项目进度 但是时间不够吗"), (2, "好的"), (3, "")], "id int, t string")
    return rows.select("id", T.punctuated(F.col("t")).alias("said"))


@query("SELECT conv_id, turn, substring(array_to_string(list_sort(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 1)), ''), 1, 30) AS signature FROM conversations")
def signature_dedup(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return read(spark, d, "conversations").select("conv_id", "turn", T.signature(words).alias("signature"))


_MEETING = (
    "今天我们讨论项目进度和计划安排。我认为项目方案需要优化，开发阶段要按计划推进。大家对客户反馈的问题进行了讨论，意见比较一致。"
    "销售人员必须完成合规培训，严格执行风险告知制度。我建议下周完成测试并提交报告，由技术团队负责跟进。"
    "客户服务的满意度有提升，成果值得肯定。风险评估由合规部门审核，发现隐患要及时处理。会议决定按照预算控制成本支出。"
)


@query()
def meeting_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, _MEETING), (2, "太短"), (3, None)], "id int, text string")
    return analyze.analyze_text(rows, "id").select("id", "summary", F.size("keywords").alias("keywords"), F.size("topics").alias("topics"), "sentiment.sentiment")


@query()
def documents_summary(spark: SparkSession, d: str) -> DataFrame:
    """A summary of every document, whatever its language."""
    docs, cores = read(spark, d, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a text takes long: a table of few splits is dealt out
        docs = docs.repartition(cores)
    return summary.summaries(docs, "doc_id").select("doc_id", "summary")


@query()
def meeting_analysis(spark: SparkSession, d: str) -> DataFrame:
    """All that is told about every conversation, scored against the built-in knowledge base."""
    items = [compliance.Item(t, c, compliance.GROUPS[k], w, p) for t, c, k, w, p in store.SEED_ITEMS]
    c = read(spark, d, "conversations")
    segments = c.select(F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("idx"), F.col("role").alias("speaker"), "text", F.col("turn").cast("double").alias("start_time"), (F.col("turn") + 1).cast("double").alias("end_time"))
    out = analyze.analyze(segments, items)
    return out.select("meeting_id", "duration", "participants", "total_score", "score_level", F.array_join("suggestions", "|").alias("suggestions"), "sentiment.sentiment", "summary")


@query()
def kmeans_diarize(spark: SparkSession, d: str) -> DataFrame:
    """Speakers of a recording whose frames are the vectors."""
    from .operators import diarize

    n = F.row_number().over(Window.partitionBy("path").orderBy("label", "vec_id")) - 1
    e = read(spark, d, "embeddings").withColumn("path", F.lit("a"))
    frames = e.select("path", n.alias("i"), F.col("embedding").cast("array<double>").alias("features"), (F.abs(F.hash("vec_id")) % 1000 / 1000).alias("rms"))
    return diarize.diarize(frames.withColumn("duration", F.max("i").over(Window.partitionBy("path")) * 512 / 16000 + 0.032), "path", speakers=3, method="kmeans")


from . import operator_queries  # noqa: E402  it adds its queries to those above

ORACLES |= {"meeting_detector": operator_queries.MEETING_SQL, "buffer_flush": operator_queries.PIECES_SQL}
