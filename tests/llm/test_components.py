import random

from colloquy.llm.components import components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def check(spark, edges):
    found = components(spark.createDataFrame(edges, "x long, y long"))
    rows = [(r["node"], r["component"]) for r in found.collect()]
    assert len(rows) == len(dict(rows))
    assert dict(rows) == brute(edges)


def test_random_graphs(spark):
    dice = random.Random(4)
    check(spark, [(dice.randrange(60), dice.randrange(60)) for _ in range(45)])


def test_long_path_and_hub(spark):
    path = [(i, i + 1) for i in range(200)]
    random.Random(1).shuffle(path)
    check(spark, path + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3), (7, None), (-5, 199)])


def test_no_edges(spark):
    check(spark, [(1, 1)])
    check(spark, [])


def test_hubs_beyond_the_limit(spark):
    check(spark, [(7, i) for i in range(100, 4000)] + [(i, 99999) for i in range(3000, 5500)] + [(200000 + i, 200001 + i) for i in range(30)])


def test_look_up(spark):
    from pyspark.sql import functions as F

    from colloquy.llm import scratch

    rows = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.when(F.col("id") < 2500, 3).otherwise(F.col("id") % 50)).alias("k"), "id")
    keyed = rows.where("k is not null and k < 40").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    for how in ("left", "inner"):
        wanted = sorted(map(str, rows.join(keyed, "k", how).collect()))
        for most in (50_000, 10):
            before, scratch.MOST_BROADCAST = scratch.MOST_BROADCAST, most
            try:
                assert sorted(map(str, scratch.look_up(rows, keyed, "k", "n", how).collect())) == wanted
            finally:
                scratch.MOST_BROADCAST = before
