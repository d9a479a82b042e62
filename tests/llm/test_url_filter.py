import random
from urllib.parse import urljoin

import duckdb
from pyspark.sql import functions as F

from colloquy.llm import scratch
from colloquy.llm import url_filter as uf


def judged(spark, urls, links, rules=None):
    u = spark.createDataFrame([(i, x, "mine") for i, x in enumerate(urls)], "id long, url string, verdict string")
    e = spark.createDataFrame(links, "source string, target string")
    return [(r["host"], r["path"], r["rule"], r["verdict"], r["by"]) for r in uf.judge(u, e, rules).orderBy("id").collect()]


def test_rules(spark):
    urls = [None, "", "no scheme", "http://a.example.COM/en/7x", "http://example.com/en/8", "http://notcom/en/", "x://sub.org/es/1?q", "https://example.net/de/8#top", "http://other.net/de/1", "http://com/en/", "http://example.com:80/en/1", "http://example.com"]
    out = judged(spark, urls, [])
    assert out[:3] == [("", "", None, "allow", "default")] * 3
    assert out[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow", "rule")
    assert out[4] == ("example.com", "/en/8", "com/en/", "block", "rule")
    assert out[5][2:] == (None, "allow", "default")
    assert out[6] == ("sub.org", "/es/1", "org/es/", "block", "rule")
    assert out[7] == ("example.net", "/de/8", "example.net/de/8", "block", "rule")
    assert out[8] == ("other.net", "/de/1", "net/de/", "allow", "rule")
    assert out[9] == ("com", "/en/", "com/en/", "block", "rule")
    assert out[10][2:4] == (None, "allow") and out[11] == ("example.com", "", None, "allow", "default")


def test_aliases(spark):
    bad, good = "http://x.com/en/1", "http://example.com/en/7"
    urls = [bad, "http://a.de/", "http://b.de/", "http://b.de/", good, "http://c.de/", "http://d.de/", None]
    links = [("http://a.de/", bad), ("http://b.de/", "http://a.de/"), ("http://b.de/", "http://a.de/"), (good, "http://b.de/"), ("http://c.de/", "http://d.de/"), (None, bad), (bad, bad), ("http://c.de/", None)]
    assert [x[3:] for x in judged(spark, urls, links)] == [("block", "rule"), ("block", "alias"), ("block", "alias"), ("block", "alias"), ("allow", "rule"), ("allow", "default"), ("allow", "default"), ("allow", "default")]


def test_named_only_in_links_and_hub(spark):
    links = [(f"http://m{i}.de/", "http://gone.com/en/") for i in range(50)]
    assert {x[3] for x in judged(spark, [f"http://m{i}.de/" for i in range(50)], links)} == {"block"}
    assert judged(spark, ["http://m1.de/"], links, [])[0][3] == "allow"


def test_links_of_pages(spark):
    rows = [
        (1, "http://h.de/a?x", '<link href="/c" REL="canonical" ><meta content="0; URL=http://z.de/?a&amp;b" http-equiv="Refresh">'),
        (2, "http://h.de/b", "<link rel=canonical href='http://h.de/b'><!-- <link rel=canonical href=/no> --><script>'<link rel=canonical href=/no>'</script>"),
        (3, None, '<link rel="canonical" href="http://q.de/">'),
        (4, "http://h.de/d", None),
        (5, "http://h.de/e", '<link rel="icon" href="/i"><link rel=canonical href="#x"><link rel=canonical href="mailto:a@b">'),
        (6, "http://h.de/f/g?y", '<link rel=canonical href="x"> <LINK rel=canonical href=//o.de/y><link rel=canonical href="?q"><meta http-equiv=refresh content="5;url=../z/./w/../v?a=../b">'),
        (7, "no scheme", "<link rel=canonical href=/x>"),
    ]
    found = uf.page_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    here = "http://h.de/f/g?y"
    want = [("http://h.de/a?x", "http://h.de/c"), ("http://h.de/a?x", "http://z.de/?a&b"), (here, "http://h.de/f/x"), (here, "http://o.de/y"), (here, "http://h.de/f/g?q"), (here, "http://h.de/z/v?a=../b")]
    assert sorted((r["source"], r["target"]) for r in found) == sorted(want)
    assert uf.page_links(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_targets_resolve_as_in_the_library(spark):
    targets = ["x", "./x", "../x", "../../x", "/a/./b/../c", "x/..", "x/.", "..", ".", "/", "?q", "/../x", "a/b/c?d/../e", "x/../../y/", "http://o.de/p"]
    bases = ["http://h.de/", "http://h.de/a", "http://h.de/a/b/c", "http://h.de/a/b/?q=/z", "http://h.de/a/b#f/"]
    pairs = [(b, t) for b in bases for t in targets]
    found = spark.createDataFrame(pairs, "b string, t string").select("b", "t", uf.resolved(F.col("t"), F.col("b")).alias("r")).collect()
    assert [(r["b"], r["t"], r["r"]) for r in found] == [(b, t, urljoin(b, t)) for b, t in pairs]


def test_spellings_are_one(spark):
    links = [("HTTP://A.de/x#here", "http://Example.COM/en/1")]
    assert [x[3] for x in judged(spark, ["http://a.de/x", "http://a.de/X", "http://a.de/x#there"], links)] == ["block", "allow", "block"]


def test_against_brute_force(spark, monkeypatch):
    """Random pages: decisions by a walk over the links, with small and with large tables."""
    dice = random.Random(3)
    urls = [f"http://{h}/{p}/{i}" for h in ("a.com", "b.org", "c.net", "example.com", "example.net") for p in ("en", "de", "es") for i in (7, 8)] + ["http://o.de/" + c for c in "abcdefgh"]
    links = [(dice.choice(urls), dice.choice(urls)) for _ in range(14)]
    seen = {u: {u} for u in urls}
    for a, b in links:
        both = seen[a] | seen[b]
        for u in both:
            seen[u] = both
    rule = {u: v for u, (_, _, _, v, by) in zip(urls, judged(spark, urls, [])) if by == "rule"}
    want = [rule.get(u, "block" if any(rule.get(x) == "block" for x in seen[u]) else "allow") for u in urls]
    for most in (50_000, 3):
        monkeypatch.setattr(scratch, "MOST_BROADCAST", most)
        assert [x[3] for x in judged(spark, urls, links)] == want


def test_clashing_names_repeats_and_long_urls(spark):
    long = "http://a.de/" + "x" * 200_000
    rows = [(long, 1, 2, 3), (long, 1, 2, 3), (None, 4, 5, 6), ("", 7, 8, 9)]
    u = spark.createDataFrame(rows, "url string, fit int, node int, rows int")
    out = uf.judge(u, spark.createDataFrame([(long, "http://x.com/en/")], "source string, target string")).collect()
    assert sorted((r["verdict"], r["by"], r["fit"], r["node"], r["rows"]) for r in out) == [("allow", "default", 4, 5, 6), ("allow", "default", 7, 8, 9), ("block", "alias", 1, 2, 3), ("block", "alias", 1, 2, 3)]


def test_sql_on_pages_with_links(spark, tmp_path):
    dice = random.Random(11)
    urls = [f"http://{h}/{p}/{i}" for h in ("m.com", "b.org", "c.net", "example.com") for p in ("en", "de", "es", "xx") for i in (7, 8)]
    tag = lambda t: f'<link rel="canonical" href="{t}">' if dice.random() < 0.5 else f'<meta http-equiv="refresh" content="0;url={t}">'
    rows = [(i, u, "<html>" + "".join(tag(dice.choice([*urls, "/xx/7", "//b.org/es/7", "8", "?a=1", "#f"])) for _ in range(dice.randint(0, 2)))) for i, u in enumerate(urls)] + [(99, None, "x"), (98, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({uf.ORACLE})").fetchall())
    found = sorted(tuple(r[n] for n in names) for r in uf.op1_redirect_equivalence(spark, str(tmp_path)).collect())
    assert found == want and sum(x[3] is None and x[4] == "block" for x in found) > 2
