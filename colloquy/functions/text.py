"""Text as column expressions: everything here stays within generated code, without Python workers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L

#: White space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CJK = "\\u4e00-\\u9fa5"


def strip(c: Column, chars: str | None = None) -> Column:
    """Without white space (any of Unicode) at both ends or, with chars, without these characters there."""
    if chars is None:
        return F.btrim(c, F.lit(WHITE))
    cls = "[" + "".join("\\" + x if x in "\\]^-[&" else x for x in chars) + "]"
    return F.regexp_replace(c, f"^{cls}+|{cls}+$", "")


def count_of(c: Column, word: str | Column) -> Column:
    """How often word occurs in c, without overlaps."""
    w = F.lit(word) if isinstance(word, str) else word
    return ((F.length(c) - F.length(F.replace(c, w, F.lit("")))) / F.length(w)).cast("long")


def has(c: Column, word: str) -> Column:
    return F.contains(c, F.lit(word))


def any_of(c: Column, patterns: Iterable[str]) -> Column:
    """Whether any regular expression is found in c; all go into one."""
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def rewrite(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Regular expression rules applied one after the other, each to what the last left."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, re.sub(r"\\(\d)", r"$\1", replacement))
    return c


def replace_all(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def pieces(c: Column, pattern: str, longer_than: int) -> Column:
    """c split at pattern; pieces are stripped and stay if longer than so many characters."""
    return F.filter(F.transform(F.split(c, pattern), lambda x: strip(x)), lambda x: F.length(x) > longer_than)


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays taken as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays without tokens of one character."""
    long = lambda x: F.filter(x, lambda t: F.length(t) > 1)
    return jaccard(long(a), long(b))


def overlap_share(a: Column, b: Column) -> Column:
    """Common elements over the length, repeats counted, of the shorter array; 0 if that is empty."""
    shorter = F.least(F.size(a), F.size(b))
    return F.when(shorter > 0, F.size(F.array_intersect(a, b)) / shorter).otherwise(F.lit(0.0))


def character_share(a: Column, b: Column) -> Column:
    """The share of a's characters that b has too."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers of one length; 0 if either is all 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def signature(tokens: Column) -> Column:
    """The sorted tokens of more than one character, joined, first 30 characters: equal for sentences of equal words."""
    return F.substring(F.array_join(F.array_sort(F.filter(tokens, lambda t: F.length(t) > 1)), ""), 1, 30)


def difference(items: Column, taken: Column) -> Column:
    """Elements of items that taken lacks, in order and with repeats."""
    return F.filter(items, lambda x: ~F.coalesce(F.array_contains(taken, x), F.lit(False)))


def negated(text: Column, keyword: Column, window: int = 15) -> Column:
    """Whether one of the words that take a risk away is among the 2 * window characters before keyword's first place."""
    at = F.instr(text, keyword)
    before = F.substring(text, F.greatest(F.lit(1), at - 2 * window), F.least(F.lit(2 * window), at - 1))
    return (at > 0) & F.coalesce(any_of(before, map(re.escape, L.NEGATED_CONTEXT)), F.lit(False))


def severity(keyword: Column) -> Column:
    k = F.lower(strip(keyword))
    return F.when(any_of(k, L.HIGH_RISK_WORDS), "high").when(any_of(k, L.MEDIUM_RISK_WORDS), "medium").otherwise("low")


def score_level(score: Column) -> Column:
    return F.when(score >= 90, "优秀").when(score >= 75, "良好").when(score >= 60, "合格").otherwise("不合格")


def convert_script(c: Column, table: Mapping[str, str]) -> Column:
    """Characters replaced one by one by a table of single characters; a table that is given, as none is built in."""
    if not table:
        return c
    return F.translate(c, "".join(table), "".join(table.values()))


def finished(c: Column) -> Column:
    """A whole summary without repeated phrases, stops and commas."""
    return strip(rewrite(c, [(f"([{CJK}]{{3,}})\\1+", r"\1"), ("。。+", "。"), ("，，+", "，"), ("会议会议", "会议"), ("参会人员参会人员", "参会人员"), ("发言者发言者", "发言者")]))


def hits(c: Column, keywords: Column) -> Column:
    """How many of an array of keywords c contains."""
    return F.size(F.filter(keywords, lambda k: F.contains(c, k)))


def worth_a_summary(c: Column, keywords: Column) -> Column:
    """Not too short, no small talk and no question, and with a keyword if short."""
    questions = sum((has(c, w).cast("int") for w in L.QUESTION_WORDS), F.lit(0))
    return (
        (F.length(c) >= 12)
        & ~(c.rlike(f"[{CJK}]") & any_of(c, L.SMALL_TALK))  # each of these has such a sign
        & ~(c.endswith("？") | c.endswith("?"))
        & ~((questions >= 2) & (F.length(c) < 40))
        & ((F.length(c) >= 20) | (hits(c, keywords) > 0))
    )


def makes_a_point(c: Column, keywords: Column) -> Column:
    """Long enough, and not only an introduction, an example or figures."""
    n = F.length(c)
    figures = F.size(F.regexp_extract_all(c, F.lit("[0-9.%]"), F.lit(0)))
    return (
        (n >= 15)
        & ~any_of(c, L.EMPTY_PATTERNS)
        & ~(c.rlike("比如|例如|举个例子|比方说|就像") & (n < 30))
        & ~((figures > 0) & (figures / n > 0.15) & (n < 40))
        & ~(c.rlike("我叫|我是|他叫|他是|她叫|她是|这位是") & (n < 30))
        & ((hits(c, keywords) > 0) | (n >= 25))
    )


def poor(c: Column, tokens: Column) -> Column:
    """Too short, or the same over and over."""
    few = (F.size(F.array_distinct(tokens)) / F.greatest(F.size(tokens), F.lit(1)) < 0.3) & (F.size(tokens) > 10)
    return F.coalesce((F.length(c) < 5) | c.rlike(r"(.{2,})\1{2,}") | c.rlike(r"(.)\1{3,}") | few, F.lit(True))


def point_score(c: Column, keywords: Column) -> Column:
    """How much a narrated sentence says: rules count most, discussion and keywords add, bare promises take away."""
    rule = any_of(c, L.NORMATIVE_PATTERNS)
    return (
        F.when(rule, 5).when(any_of(c, L.PROMISE_PATTERNS), -10).otherwise(0)
        + F.when(any_of(c, L.DISCUSSION_PATTERNS), 2).otherwise(0)
        + hits(c, keywords)
        + F.length(c).between(20, 60).cast("int")
    )


def invented(summary: Column, source: Column, summary_tokens: Column, source_tokens: Column) -> Column:
    """Whether a summary has signs of news that the source has not, or mostly longer words that it has not.

    A sign that is a pattern counts whenever it is found, as its source text is what is looked for.
    """
    news = F.lit(False)
    for p in L.NEWS_PATTERNS:
        news = news | (summary.rlike(p) & ~has(source, p))
    names = lambda t: F.array_except(F.filter(F.array_distinct(t), lambda x: F.length(x) >= 3), F.array(*map(F.lit, L.STOP_WORDS_ZH)))
    own = names(summary_tokens)
    new = F.size(F.array_except(own, names(source_tokens)))
    return news | ((F.size(own) > 0) & (new > 0.6 * F.size(own)))


def action_items(c: Column, patterns: Sequence[str] | None = None, most: int = 5) -> Column:
    """The first action items, those of the first pattern before those of the next, without repeats."""
    found = F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in patterns or L.ACTION_PATTERNS_ZH)))
    if not patterns:  # each of these ends at a stop
        found = F.when(has(c, "。") | has(c, "！") | has(c, "？"), found).when(c.isNotNull(), F.array().cast("array<string>"))
    clean = F.transform(found, lambda x: strip(x, "。！？. \n"))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: F.length(x) > 5)), 1, most)


def title_of(content: Column, name: Column) -> Column:
    """A short first line without signs, else the file name without its extension."""
    first = F.split(strip(F.coalesce(content, F.lit(""))), "\n")[0]
    clean = F.regexp_replace(first, f"[^{CJK}a-zA-Z0-9_-]", "")
    return F.when((F.length(first) <= 50) & (F.length(clean) >= 2), clean).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def required_points(content: Column, most: int = 5) -> Column:
    """The first lines of 6 to 80 characters that are numbered, bulleted or end a sentence, without their marks.

    A sentence is left out if the whole line is among the points, a listed line if what remains of it is.
    """
    number, bullet = r"^[一二三四五六七八九十\d]+[、.．)）]", r"^[-*●•·]"
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: strip(x)), lambda x: F.length(x).between(6, 80))

    def add(points: Column, line: Column) -> Column:
        listed = F.when(line.rlike(number), F.regexp_replace(line, number + r"\s*", "")).when(line.rlike(bullet), F.regexp_replace(line, bullet + r"\s*", ""))
        sentence = F.when(line.endswith("。") | line.endswith("；"), F.expr("1") == 1)
        full = F.size(points) >= most
        append = lambda x: F.concat(points, F.array(x))
        return (
            F.when(full, points)
            .when(listed.isNotNull(), F.when((listed != "") & ~F.array_contains(points, listed), append(listed)).otherwise(points))
            .when(sentence & ~F.array_contains(points, line), append(F.substring(line, F.lit(1), F.length(line) - 1)))
            .otherwise(points)
        )

    return F.aggregate(lines, F.array().cast("array<string>"), add)


def punctuated(c: Column) -> Column:
    """A raw transcript without spaces and with commas, stops and line ends put in by cue words and particles."""
    t = replace_all(strip(c), [(" ", ""), ("\u3000", ""), ("\xa0", "")])
    t = replace_all(t, [(w, "，" + w) for w in L.COMMA_BEFORE])
    t = replace_all(t, [(w, w + "，") for w in L.COMMA_AFTER])
    t = rewrite(t, [(r"(?U)([。！？])\s*，", r"\1"), ("，，+", "，")])
    ask = lambda t, w: F.when(F.contains(t, F.concat(w, F.lit("？"))), t).otherwise(F.replace(t, w, F.concat(w, F.lit("？"))))
    t = F.aggregate(F.array(*map(F.lit, L.QUESTION_PARTICLES)), t, ask)
    t = rewrite(t, [(f"{w}(?=[{CJK}])", w + "。") for w in L.STOP_PARTICLES])
    t = rewrite(t, [("([。！？])+", r"\1"), (r"(?s)([^。！？])\z", r"\1。")])
    return strip(rewrite(t, [(r"([。！？])([^\n])", "\\1\n\\2")]))


def clock(seconds: Column) -> Column:
    """mm:ss.mmm of whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d.000", F.floor(s / 60), s % 60)


def flag(c: Column) -> Column:
    """Whether a form field says true."""
    return F.coalesce(F.lower(c) == "true", F.lit(False))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))
