"""URL rules, with block decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import free, look_up, table

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null url or one without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From after the host up to ?, # or the end; empty for a null url or one without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The rule that fits, as struct(size, allow, rule, verdict), or null: the longest, an allow before a block.

    A rule fits its host and all subdomains of it where the path starts with the rule's. The rules are literals of
    the plan: a policy's few lines, not a table.
    """
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(verdict == "allow").alias("allow"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,allow:boolean,rule:string,verdict:string>")


#: What holds no tags, and the tags and attributes that declare links.
NO_TAGS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
LINK, CANONICAL, HREF = r"(?is)<link\s[^>]*>", r"""(?is)\srel\s*=\s*["']?\s*canonical\b""", r"""(?is)\shref\s*=\s*["']?\s*([^"'\s>]+)"""
META, REFRESH, URL = r"(?is)<meta\s[^>]*>", r"""(?is)\shttp-equiv\s*=\s*["']?\s*refresh\b""", r"""(?is)url\s*=\s*["']?([^"'\s>]+)"""


def key_of(url: Column) -> Column:
    """One spelling of a url: scheme and host in lower case, without a fragment."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.regexp_replace(F.substr(url, F.length(head) + 1), r"(?s)#.*$", ""))


def without_dots(path: Column) -> Column:
    """A path that begins with /, without its steps . and .. ; the latter takes the step before it off."""
    steps = F.split(path, "/")
    dots = F.element_at(steps, -1).isin(".", "..")
    fold = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.lit(1), F.size(done) - 1))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    return F.when(path.contains("/."), F.concat(F.array_join(fold, "/"), F.when(dots, F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """What a link's target names on the page at url; null if it names no other document."""
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    given = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    below = F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1), given)
    below = F.when(below.startswith("/"), below).otherwise(F.concat(F.lit("/"), below))
    return (
        F.when(target.rlike(r"(?s)^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.when(target.contains("://"), target))
        .when((origin == "") | (target == "") | target.startswith("#"), None)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .otherwise(F.concat(origin, without_dots(F.when(given.startswith("/"), given).otherwise(below)), rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target): all canonical links and refresh redirects that pages declare outside of comments, scripts and
    styles, with targets resolved against the page's url. Pages without a url or html declare none; repeated pages
    repeat their links.
    """
    html = F.regexp_replace("html", NO_TAGS, " ")

    def declared(tag: str, kind: str, target: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(kind))
        return F.transform(tags, lambda t: F.regexp_extract(t, target, 1))

    both = F.concat(declared(LINK, CANONICAL, HREF), declared(META, REFRESH, URL))
    rows = pages.where("url is not null and html is not null").select(F.col("url").alias("source"), F.explode(both).alias("target"))
    target = resolved(F.replace(F.col("target"), F.lit("&amp;"), F.lit("&")), F.col("source"))
    return rows.select("source", target.alias("target")).where("target is not null and source <> target")


def judge(urls: DataFrame, links: DataFrame, rules: list[tuple[str, str, str]] | None = None, url: str = "url") -> DataFrame:
    """urls plus host, path, rule, verdict and by (rule, alias or default), replacing columns of these names.

    A url that a rule fits has that rule's verdict: an explicit allow is never overruled. Any other url is blocked
    if a url that a rule blocks, or that the link table alone names and a rule blocks, is equivalent to it over
    the links in either direction; else it is allowed. Urls that differ in the case of scheme and host, or in their
    fragment, are one in this. Equivalence does not pass a decision through an explicitly allowed url's own verdict,
    but it does join what lies beyond it. Null urls fit no rule, have no aliases and are allowed. Repeated urls and
    links count once for equivalence; each row of urls is judged. Urls are told apart by 64-bit hashes within the
    graph. Large components and urls that many rows have are looked up without gathering.
    """
    rules = RULES if rules is None else rules
    keep = urls.drop("host", "path", "rule", "verdict", "by")
    fit, node, rows = free(keep, "fit", "node", "rows")
    at = keep.select("*", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    at = at.withColumn(fit, best_rule(F.col("host"), F.col("path"), rules)).withColumn(node, F.xxhash64(key_of(F.col(url))))
    at = at.withColumn(node, F.when(F.col(url).isNotNull() & F.col(fit).isNull(), F.col(node)))
    links = links.where("source is not null and target is not null").select(key_of(F.col("source")).alias("source"), key_of(F.col("target")).alias("target"))
    links = table(links.where("source <> target").dropDuplicates(), "links")
    if links.isEmpty():  # nothing is equivalent to anything else
        judged = at.withColumn(rows, F.lit(None).cast("long"))
    else:
        ends = links.select(F.explode(F.array("source", "target")).alias("u")).distinct()
        said = best_rule(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"]
        named = table(ends.select(F.xxhash64("u").alias("node"), said.alias("said")).join(components(links.select(F.xxhash64("source"), F.xxhash64("target"))), "node"), "named")
        parts = named.groupBy("component").agg(F.count("*").alias("n"), F.max(F.col("said") == "block").alias("bad"))
        bad = look_up(named.where("said is null"), table(parts.where("bad"), "bad"), "component", "n", "inner").select(F.col("node").alias(node))
        counted = at.where(F.col(node).isNotNull()).groupBy(node).agg(F.count("*").alias(rows))
        judged = look_up(at, table(counted.join(bad, node), "blocked"), node, rows)
    by = F.when(F.col(fit).isNotNull(), "rule").when(F.col(rows).isNotNull(), "alias").otherwise("default")
    verdict = F.coalesce(F.col(fit)["verdict"], F.when(F.col(rows).isNotNull(), "block").otherwise("allow"))
    return judged.select(*keep.columns, "host", "path", F.col(fit)["rule"].alias("rule"), verdict.alias("verdict"), by.alias("by"))


def op1_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages.select("page_id", "url"), page_links(pages)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH RECURSIVE rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
plain AS (SELECT url, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS html FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
tags AS (
  SELECT url AS source, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM plain),
targets AS (
  SELECT source, replace(CASE WHEN regexp_matches(tag, '(?is)^<link') AND regexp_matches(tag, '(?is)\srel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta') AND regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)url\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS t,
    regexp_extract(source, '(?s)^(.*?://[^/?#]*)', 1) AS origin, regexp_extract(source, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM tags),
links AS (  -- targets with steps . and .. are left as they are
  SELECT source, CASE WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN CASE WHEN contains(t, '://') THEN t END
    WHEN origin = '' OR starts_with(t, '#') THEN NULL
    WHEN starts_with(t, '//') THEN regexp_extract(source, '(?s)^(.*?:)//', 1) || t
    WHEN starts_with(t, '/') THEN origin || t
    WHEN starts_with(t, '?') THEN origin || path || t
    ELSE origin || CASE WHEN starts_with(path, '/') THEN regexp_extract(path, '(?s)^(.*/)', 1) ELSE '/' END || t END AS target
  FROM targets WHERE t <> ''),
urls AS (SELECT url AS u FROM pages WHERE url IS NOT NULL UNION SELECT source FROM links UNION SELECT target FROM links WHERE target IS NOT NULL),
keys AS (
  SELECT u, translate(regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_replace(substr(u, length(regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1)) + 1), '(?s)#.*$', '') AS k FROM urls),
pairs AS (SELECT DISTINCT x.k AS a, y.k AS b FROM links l JOIN keys x ON x.u = l.source JOIN keys y ON y.u = l.target WHERE x.k <> y.k),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
parts AS (
  SELECT u, translate(coalesce(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM urls),
fits AS (
  SELECT u, arg_max(r.h || r.p, length(r.h || r.p) * 2 + CASE WHEN r.verdict = 'allow' THEN 1 ELSE 0 END) AS rule,
    arg_max(r.verdict, length(r.h || r.p) * 2 + CASE WHEN r.verdict = 'allow' THEN 1 ELSE 0 END) AS said
  FROM parts JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY u),
bad(k) AS (
  SELECT k FROM fits JOIN keys USING (u) WHERE said = 'block' AND k IN (SELECT a FROM edges)
  UNION SELECT e.b FROM bad JOIN edges e ON e.a = bad.k)
SELECT p.page_id, coalesce(q.host, '') AS host, coalesce(q.path, '') AS path, f.rule AS rule,
  coalesce(f.said, CASE WHEN b.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN parts q ON q.u = p.url LEFT JOIN fits f ON f.u = p.url LEFT JOIN keys k ON k.u = p.url LEFT JOIN bad b ON b.k = k.k
"""
