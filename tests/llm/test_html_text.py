import random
import time

import pytest

from colloquy.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body class="page with-sidebar">
<header class="top"><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><header><h2>{title}</h2></header><p>{a}<br>more &amp; <b>bold</b>&nbsp;text<p>{b}<ul><li>one<li>two</ul><div class="ad">Buy</div><p>{tail}</p>
<section id="comments"><p>reader says</p></section><form><label>Mail</label></form></article>
<aside>side</aside><div role="navigation">nav</div><footer>foot</footer></body></html>"""


def text_of(source):
    return ht.main_text(ht.parse(source))


def test_article_of_a_full_page():
    source = PAGE.format(title="T &lt;1&gt;", a="First\n  line", b="Second", tail="Last")
    assert text_of(source) == "T <1>\n\nFirst line more & bold text\n\nSecond\n\none\n\ntwo\n\nLast"


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("plain words", "plain words"),
        ("<p>a<p>b", "a\n\nb"),
        ("<p><b>a.<br><p>b</p>", "a.\n\nb"),
        ("<div>a<span>b</span>c</div>d", "abc\n\nd"),
        ("<p>a<!-- x --><!-- unfinished", "a"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p title='>'>a</p>", "a"),
        ("<p>a</b></div></p>b", "a\n\nb"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<script>if (a < b) '</p>'", ""),
        ("<p hidden>a</p><p aria-hidden=true>b</p><p>c</p>", "c"),
        ("<p class='headline readable'>kept</p><p class='advert'>gone</p>", "kept"),
        ("<main><p>in</p></main><p>out</p>", "in"),
        ("<p>" + "x " * 100000 + "</p>", ("x " * 100000).strip()),
        ("<div>" * 5000 + "deep", "deep"),
    ],
)
def test_odd_markup(source, text):
    assert text_of(source) == text


@pytest.mark.parametrize(
    "source,text",
    [
        ("<article style='overflow:hidden'><p>a</p></article>", "a"),
        ('<div title="Hidden gems" data-id="ad-7" data-role=banner data-class="menu"><p>a</p></div>', "a"),
        ('<div title="a hidden class=ad id=menu"><p>a</p></div>', "a"),
        ('<p data-x="1"hidden>a</p><p HIDDEN="">b</p><p Role = banner>c</p><p class=x class=ad>d</p>', "d"),
        ('<div class="content has-sidebar"><p>out</p><article><p>in</p></article></div>', "in"),
        ('<div class="page with-footer"><main><p>in</p><div class="sidebar">side</div></main></div>', "in"),
        ('<div class="nav-layout"><div id="menu-page"><article>in</article><div class="related"><article>other</article></div></div></div>', "in"),
        ('<div class="social-story"><article>in</article></div>', "in"),
        ('<p>text</p><div class="comments"><article class="comment">said</article></div>', "text"),
        ('<p>text</p><div class="sidebar"><aside><article>other</article></aside></div>', "text"),
    ],
)
def test_what_is_left_out(source, text):
    assert text_of(source) == text


def brute_match(a, b):
    if a.tag != b.tag:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, c in enumerate(a.children):
        for j, d in enumerate(b.children):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_match(c, d))
    return 1 + m[-1][-1]


def test_matching_is_the_largest():
    dice = random.Random(3)

    def tree(depth):
        node = ht.Node(dice.choice("ab"))
        node.children = [tree(depth - 1) for _ in range(dice.randint(0, 3))] if depth else []
        return node

    for _ in range(150):
        a, b = tree(3), tree(3)
        a.tag = b.tag = "r"
        m = ht.Matcher()
        m.shape(a), m.shape(b)
        assert m.size(a, b) == brute_match(a, b)


def test_long_lists_are_aligned_as_short_ones(monkeypatch):
    dice = random.Random(8)

    def tree(depth, most):
        node = ht.Node(dice.choice("abc"))
        node.children = [tree(depth - 1, 3) for _ in range(dice.randint(0, most))] if depth else []
        return node

    for _ in range(60):
        a, b = tree(3, 12), tree(3, 12)
        a.tag = b.tag = "r"
        found = []
        for small in (1 << 60, 0):
            monkeypatch.setattr(ht.Matcher, "SMALL", small, raising=False)
            m = ht.Matcher()
            m.shape(a), m.shape(b)
            found.append((m.size(a, b), m._pairs.get((a.shape, b.shape))))
        assert found[0] == found[1]


def test_template_after_long_lists():
    pages = [ht.parse("<div>" + "".join(f"<p>story {k} {i}</p>\n" for i in range(n)) + "<p>All rights reserved</p></div>") for k, n in enumerate([1100, 1300, 1101, 1210, 1105, 1250, 1400, 1120])]
    ht.induce(pages)
    assert not any("All rights" in ht.main_text(p) for p in pages)
    assert all(ht.main_text(p).startswith(f"story {k} 0\n") for k, p in enumerate(pages))


def test_constant_texts_are_the_templates():
    dice = random.Random(5)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(8))
    own = [[word() for _ in range(dice.randint(1, 6))] for _ in range(12)]
    pages = [ht.parse("<div><p>Welcome to the site</p><div>" + "".join(f"<p>{w}</p>" for w in o) + "</div><p>All rights reserved</p></div>") for o in own]
    ht.induce(pages)
    assert [ht.main_text(p) for p in pages] == ["\n\n".join(o) for o in own]


def words(dice, n):
    return " ".join("".join(dice.choices("abcdefghijklmnop", k=dice.randint(2, 9))) for _ in range(n))


def induced(sources):
    return ht.texts_of(sources, True)


def test_equal_pages_lose_nothing():
    assert induced(["<p>same</p>"] * 8) == ["same"] * 8
    assert set(induced([f"<title>{i}</title><article><h1>One</h1><p>the same body</p></article>" for i in range(6)])) == {"One\n\nthe same body"}
    assert set(induced([f"<div>menu {i}</div><article><p>the same body</p></article>" for i in range(6)])) == {"the same body"}


def test_alignment_finds_the_content_of_an_unknown_template():
    """No element and no class tells here what is content."""
    dice = random.Random(21)
    pages, want = [], []
    for i in range(9):
        body = [words(dice, dice.randint(30, 90)) for _ in range(dice.randint(2, 6))]
        title = words(dice, 5)
        links = "".join(f'<a href="/{k}">{words(dice, 2)}</a> ' for k in range(dice.randint(4, 8)))
        pages.append(
            f'<div class="q1"><div>{words(dice, 3)}</div><p>Our site</p></div><div class="q2"><div class="z">{links}</div><div class="q3"><h1>{title}</h1>'
            + "".join(f"<p>{x}</p>" for x in body)
            + f'<p class="t">All about it, every day</p></div></div><div class="q4"><div>Call {dice.randrange(10**6)}</div><div>Imprint and {words(dice, 2)}</div></div>'
        )
        want.append("\n\n".join([title, *body]))
    assert induced(pages) == want
    assert ht.texts_of(pages, False) != want and induced(pages[:2]) != want


@pytest.mark.parametrize("tag", ["main", "article"])
def test_small_and_linked_parts_of_an_article_stay(tag):
    dice = random.Random(3)
    words = lambda n: " ".join(dice.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(n))
    pages, want = [], []
    for k in range(12):
        long = [words(60) + f" {k}." for _ in range(3)]
        body = "".join(f"<p>{p}</p>" for p in long)
        pages.append(f"<body><div class='t'><a href='/'>Start</a></div><{tag}><div class='lead'><p>Short lead {k}.</p></div><div class='b'>{body}</div><div><a href='/{k}'>See page number {k} for links</a></div><div class='end'><p>End {k}.</p></div></{tag}><div>All rights</div></body>")
        want.append("\n\n".join([f"Short lead {k}.", *long, f"See page number {k} for links", f"End {k}."]))
    assert ht.texts_of(pages, True) == want
    assert ht.texts_of(pages, False) == want


def test_records_without_a_name():
    """A varying number of like places side by side: all of them are content."""
    dice = random.Random(4)
    texts = [[words(dice, 40) for _ in range(dice.randint(1, 5))] for _ in range(10)]
    pages = [f'<div class="h">Head {i}</div>' + "".join(f'<div class="r"><div>{x}</div></div>' for x in own) + "<div>Foot</div>" for i, own in enumerate(texts)]
    assert induced(pages) == ["\n\n".join(own) for own in texts]


def test_shared_sentences_of_articles_stay():
    dice = random.Random(6)
    recipes = [(words(dice, 3), words(dice, 30), words(dice, 25)) for _ in range(12)]
    shared = "Preheat the oven to 180 degrees."
    for form, want in (
        ("<article><h1>{0}</h1><h2>Method</h2><p>" + shared + "</p><p>{1}</p><p>{2}</p></article>", "{0}\n\nMethod\n\n" + shared + "\n\n{1}\n\n{2}"),
        ("<div><h1>{0}</h1><p>{1}</p><p>" + shared + "</p><p>{2}</p></div><div>Foot</div>", "{0}\n\n{1}\n\n" + shared + "\n\n{2}"),
        ("<div><h1>{0}</h1><ol><li>" + shared + "</li><li>{1}</li><li>{2}</li></ol></div><div>Foot</div>", "{0}\n\n" + shared + "\n\n{1}\n\n{2}"),
        ("<article><h1>{0}</h1><p>See <b>here</b>: {1}</p><div>Share it</div><p>{2}</p></article>", "{0}\n\nSee here: {1}\n\n{2}"),
    ):
        assert induced([form.format(*r) for r in recipes]) == [want.format(*r) for r in recipes]


def test_a_page_of_another_kind_keeps_its_own():
    dice = random.Random(8)
    pages = [f"<div>Menu</div><div><h1>{words(dice, 3)}</h1><p>{words(dice, 40)}</p></div>" for _ in range(9)] + ["<table><tr><td>quite</td><td>another</td></tr></table>"]
    assert induced(pages)[-1] == "quite\n\nanother" and not any("Menu" in t for t in induced(pages)[:-1])


@pytest.mark.parametrize("source", ["<h1 class='header'>a</h1>", "<h2 id='related-work'>a</h2>", "<section class='promotion'><p>a</p></section>", "<p title='the hidden truth'>a</p>", "<p data-x='class=ad'>a</p>", "<p title=hidden>a</p>"])
def test_words_elsewhere_drop_nothing(source):
    assert text_of(source) == "a" and text_of(f"<article>{source}</article>") == "a"


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "mainNav", "site-header", "comments_area", "sidebar left"])
def test_names_that_mark(name):
    assert text_of(f"<p>a</p><div class='{name}'>b</div>") == "a" and text_of(f"<p>a</p><div id='{name.split()[0]}'>b</div>") == "a"


def test_deep_pages_of_one_host():
    dice = random.Random(2)
    for tag in ("div", "b", "ul", "span"):
        pages = [f"<{tag}>" * 10_000 + words(dice, 5 + i) + f"</{tag}>" * 9_000 for i in range(7)]
        assert [len(t.split()) for t in induced(pages)] == [5 + i for i in range(7)]


@pytest.mark.parametrize("piece", ['<a "', "<a x='", "<b>", "</i>", "<p><b>", "<!--", "<a x=\"", "<a ", "<script>", "&#", "<i></b>", "<li>", "<a = ", "<", "<div x='\">"])
def test_hostile_markup_takes_linear_time(piece):
    took = []
    for size in (1 << 17, 1 << 20):
        source = "<div><i>" + piece * (size // len(piece))
        began = time.process_time()
        text_of(source)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1 and took[1] < 25


def test_clashing_names(spark):
    names = "page_id long, url string, html string, host int, _host int, page int, block string, lead int, rows int, blocks int"
    rows = [(i, "http://a.de/x", f"<article><p>{i % 30}</p></article>", *([i] * 3), str(i), *([i] * 3)) for i in range(700)]
    out = ht.extract(spark.createDataFrame(rows, names)).collect()
    assert sorted((r["page_id"], r["text"], r["host"], r["block"], r["rows"]) for r in out) == sorted((i, str(i % 30), i, str(i), i) for i in range(700))


def test_copies_are_no_template(spark):
    other = [f"<div><p>Welcome</p><p>story {i * 7919}</p></div>" for i in range(100)]
    rows = [(i, f"http://hot.de/{i}", h) for i, h in enumerate(other)]
    rows += [(1000 + i, f"http://hot.de/{'same' if i % 2 else i}", "<div><p>Welcome</p><p>often told</p></div>") for i in range(300)]
    rows += [(2000 + i, "http://cold.de/", "<p>seldom told</p>") for i in range(7)]
    rows += [(3000 + i, f"http://stamped.de/{i}", f"<!-- made at {i} --><p>one text</p><footer>{i}</footer>") for i in range(20)]
    out = {r["page_id"]: r["text"] for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    assert all(out[i] == f"story {i * 7919}" for i in range(100))
    assert {out[1000 + i] for i in range(300)} == {"often told"}
    assert {out[2000 + i] for i in range(7)} == {"seldom told"} and {out[3000 + i] for i in range(20)} == {"one text"}


def test_columns(spark):
    rows = [(i, f"http://hot.de/{i}", f"<article><p>story {i * 7919}</p></article>", 5) for i in range(150)]
    rows += [(1000, None, "<p>a</p>", 0), (1001, "no scheme", None, 0), (None, "http://b.de", "<p>c  d</p>", 0), (None, "http://b.de", "<p>c  d</p>", 0)]
    out = ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r["text"] for r in out if r["page_id"] is not None}
    assert all(by[i] == f"story {i * 7919}" for i in range(150)) and by[1000] == "a" and by[1001] == ""
    assert [r["n_chars"] for r in out if r["page_id"] is None] == [3, 3]
    assert ht.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table_against_the_known_template(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found = {r["page_id"]: r["text"] for r in ht.op7_wrapper_extraction(spark, "/root/testdata/sf0.01").collect()}
    for p in pages:
        inner = p["html"].split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>|<br>", inner))
        assert found[p["page_id"]] == "\n\n".join(x for x in parts if x)
