"""Main text of web pages by wrapper induction.

Pages of one host come from one template. In blocks of at most a few dozen pages of a host, each page's tree is
aligned with a reference page's by simple tree matching. Elements that stand at the same place in nearly all pages
are the template's, and so are texts that are equal there; of the template's places, the one that holds what varies
is the content. Going down from the root, side places that hold little beside it (menus, notices, footers, whatever
they are called) are left behind. Elements that HTML itself defines as no part of the content (nav, footer, form and
so on) never are; words of a class are asked only where alignment can't tell: on a page that has no like, and for
other texts (comments, adverts) within the content.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import bounded, free, look_up, plus, table
from .url_filter import host_of

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an open p ends before.
ENDS_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr option legend".split())
#: Elements that end an open one of the listed names, up to the named container.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
SKIPPED = frozenset("head script style noscript template nav header footer aside form button select textarea iframe object svg math canvas audio video menu dialog title xmp noembed noframes".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is no part of an article.
SKIPPED_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices popup modal newsletter subscribe "
    "comment comments disqus respond sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead related share sharing social widget toolbar pagination pager skip".split()
)
#: Those of them that mark another kind of text; the others may also stand in the class of a wrapper of the article.
OTHER_TEXTS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo newsletter subscribe comment comments disqus respond related share sharing social".split()
)
#: Words that may stand beside these in one name ("main-nav", "ads_box") and mark nothing themselves.
BESIDE = frozenset("site page main top bottom left right box block wrapper wrap container section area list item items links inner outer bar global primary secondary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold others rather than text, through which the content is looked for.
CONTAINERS = frozenset("html body div section article main center table tbody tr td hgroup".split())
#: A tag: its name ends at white space, / or >; quotes count only after =, as in browsers. One that never ends takes the rest.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: Elements nest no deeper in a tree; what stands deeper becomes a sibling there, as in browsers.
DEEPEST = 512


class Node:
    """An element, or a text (tag '#')."""

    __slots__ = ("tag", "skip", "children", "text", "shape", "fixed", "label", "mark", "place", "content", "links", "at", "slots")

    def __init__(self, tag: str, skip: int = 0, text: str = "", label: str = ""):
        self.tag, self.skip, self.text, self.label = tag, skip, text, label
        self.children: list[Node] = []
        self.shape: int = -1
        self.fixed = False  # the template's
        self.mark = 0  # for texts that many pages have: which
        self.place: Node | None = None  # the reference page's node that it is aligned with
        self.at: list[Node] = []  # of a reference page's node: all nodes aligned with it, its own among them
        self.content = self.links = 0  # characters below it that vary, outside and inside of links
        self.slots: list[Node] | None = None  # of a root: where alignment found the content


#: Why an element is left out (`skip`): for good, or by a word of its class or id unless it holds an article.
KEPT, LEFT_OUT, BY_CLASS, OTHER_TEXT = range(4)


def _attributes(source: str) -> dict[str, str]:
    """Values by exact name in lower case; the first of a name counts, as in browsers."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in ("'", '"'):
            value = value.strip(value[0])
        found.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    return found


def _marked(name: str) -> int:
    """What a class or an id says: each word of it has to mark what is left out, or to be neutral beside one that does."""
    words = {part.lower() for part in _NAME_PARTS.split(name) if part}
    found = words & SKIPPED_CLASSES
    if not found or words - found - BESIDE:
        return KEPT
    return OTHER_TEXT if found & OTHER_TEXTS else BY_CLASS


def _left_out(tag: str, own: dict[str, str], in_article: bool) -> int:
    if tag in SKIPPED:
        return KEPT if tag == "header" and in_article else LEFT_OUT  # an article's own header has its title
    if not own:
        return KEPT
    if own.get("role", "").strip().lower() in SKIPPED_ROLES or "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true":
        return LEFT_OUT
    if tag in HEADINGS or tag in ("html", "body"):
        return KEPT
    skip = max((_marked(x) for x in (*own.get("class", "").split(), own.get("id", ""))), default=KEPT)
    return skip if tag not in ("article", "main") or skip == OTHER_TEXT and "comment" in own.get("class", "").lower() else KEPT


def _open_wrappers(articles: list[list[Node]]) -> None:
    """Keeps what a class left out if it holds an article or main: given are the elements left out around each of these.

    What is marked as another kind of text (related articles, comments) is kept only where no article stands outside such.
    """
    seen = [around for around in articles if all(x.skip != LEFT_OUT for x in around)]
    outside = [around for around in seen if all(x.skip != OTHER_TEXT for x in around)]
    for around in outside or seen:
        for x in around:
            x.skip = KEPT


def parse(source: str) -> Node:
    """The tree of any text: end tags that HTML lets out are supplied, stray ones are passed over."""
    root = Node("html")
    open_ = [root]
    articles = 0
    around: list[list[Node]] = []
    at = 0
    n = len(source)
    scan = _TOKEN.search

    def add_text(raw: str) -> None:
        if raw:
            open_[-1].children.append(Node("#", text=entities.unescape(raw) if "&" in raw else raw))

    names: dict[str, int] = {}  # open elements by name
    while at < n:
        m = scan(source, at)
        if m is None:
            add_text(source[at:])
            break
        add_text(source[at : m.start()])
        at = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if tag is None:
            continue
        tag = tag.lower()

        def end_from(k: int) -> None:
            nonlocal articles
            for x in open_[k:]:
                names[x.tag] -= 1
                articles -= x.tag in ("article", "main")
            del open_[k:]

        if closing:
            if names.get(tag):
                lowest = 0 if tag in BLOCKS else max(0, len(open_) - DEEPEST)
                for k in range(len(open_) - 1, lowest, -1):
                    name = open_[k].tag
                    if name == tag:
                        end_from(k)
                        break
                    if name in BLOCKS and tag not in BLOCKS:
                        break  # an end tag of an inline element doesn't end a block
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P and names.get("p"):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    end_from(k)
                    break
                if open_[k].tag in BLOCKS:
                    break
        if tag in ENDS:
            ended, within = ENDS[tag]
            for k in range(len(open_) - 1, max(0, len(open_) - DEEPEST), -1):
                if open_[k].tag in ended.split():
                    end_from(k)
                    break
                if open_[k].tag in within:
                    break
        own = _attributes(attributes) if attributes and not attributes.isspace() else {}
        node = Node(tag, _left_out(tag, own, articles > 0), label=f"{tag}.{' '.join(own.get('class', '').split())}")
        if len(open_) < DEEPEST:
            open_[-1].children.append(node)
        else:
            open_[DEEPEST - 1].children.append(node)
            node.skip = node.skip or open_[-1].skip
        if tag in ("article", "main") and not node.skip:
            around.append([x for x in open_[:DEEPEST] if x.skip])
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
            if tag == "textarea" or tag == "title":
                node.children.append(Node("#", text=entities.unescape(source[at : end.start() if end else n])))
            at = end.end() if end else n
        elif tag not in VOID and not (attributes or "").rstrip().endswith("/"):
            open_.append(node)
            names[tag] = names.get(tag, 0) + 1
            articles += tag in ("article", "main")
    _open_wrappers(around)
    return root


class Matcher:
    """Simple tree matching: the most pairs of nodes with equal tags that keep order and ancestry, roots matched.

    A pair of texts of one mark weighs EQUAL more. Sizes depend on the trees' shapes alone, so they are kept by pairs
    of shapes, as is the alignment of children.
    """

    EQUAL = 2

    #: Children lists of more pairs than this are aligned by rows of arrays; the alignment is the same.
    SMALL = 1 << 12

    def __init__(self):
        self._shapes: dict[tuple, int] = {}
        self._sizes: dict[tuple[int, int], int] = {}
        self._pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def shape(self, root: Node) -> None:
        """Numbers equal shapes equally, from the leaves up."""
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children)
        for node in reversed(order):
            key = (node.tag, node.mark, *[c.shape for c in node.children])
            node.shape = self._shapes.setdefault(key, len(self._shapes))

    def size(self, a: Node, b: Node) -> int:
        if a.tag != b.tag:
            return 0
        if not a.children or not b.children:
            return 1 + (self.EQUAL if a.mark and a.mark == b.mark else 0)
        if (a.shape, b.shape) not in self._sizes:
            todo = [(a, b)]
            while todo:  # the pairs below come first; without recursion, as trees may be deep
                a_, b_ = todo[-1]
                below = self._below(a_, b_)
                if below:
                    todo += below
                else:
                    todo.pop()
                    if (a_.shape, b_.shape) not in self._sizes:
                        self._align(a_, b_, (a_.shape, b_.shape))
        return self._sizes[a.shape, b.shape]

    def _below(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Pairs of children whose size is yet to be known for that of a and b."""
        if (a.shape, b.shape) in self._sizes:
            return []
        if a.shape == b.shape:
            pairs = {c.shape: (c, d) for c, d in zip(a.children, b.children)}.values()
        else:
            x, y = ({c.shape: c for c in n.children if c.children}.values() for n in (a, b))
            pairs = ((c, d) for c in x for d in y)
        return [(c, d) for c, d in pairs if c.tag == d.tag and c.children and d.children and (c.shape, d.shape) not in self._sizes]

    def _align(self, a: Node, b: Node, key: tuple[int, int]) -> None:
        x, y = a.children, b.children
        if a.shape == b.shape:
            self._pairs[key] = [(i, i) for i in range(len(x))]
            self._sizes[key] = 1 + sum(self.size(c, d) for c, d in zip(x, y))
            return
        if len(x) * len(y) > self.SMALL:
            self._pairs[key], total = self._align_long(x, y)
            self._sizes[key] = 1 + total
            return
        rows = [[0] * (len(y) + 1)]
        weights = []
        for c in x:
            above, row, own = rows[-1], [0], []
            left = 0
            for j, d in enumerate(y):
                w = self.size(c, d) if c.tag == d.tag else 0
                own.append(w)
                best = above[j] + w if w else 0
                if above[j + 1] > best:
                    best = above[j + 1]
                if left > best:
                    best = left
                row.append(best)
                left = best
            rows.append(row)
            weights.append(own)
        pairs, i, j = [], len(x), len(y)
        while i and j:
            if weights[i - 1][j - 1] and rows[i][j] == rows[i - 1][j - 1] + weights[i - 1][j - 1]:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        self._pairs[key], self._sizes[key] = pairs[::-1], 1 + rows[-1][-1]

    def _align_long(self, x: list[Node], y: list[Node]) -> tuple[list[tuple[int, int]], int]:
        """What _align's table gives for these children, with about sqrt(len(x)) of its rows held at a time.

        A row's best is the running maximum of what the row above and each pair give. Equal shapes at the ends are
        pairs of that alignment, so they are cut off first.
        """
        n, m, total = len(x), len(y), 0
        pairs: list[tuple[int, int]] = []
        while n and m and x[n - 1].shape == y[m - 1].shape:
            n, m = n - 1, m - 1
            pairs.append((n, m))
            total += self.size(x[n], y[m])
        kinds: dict[int, int] = {}
        kind = np.array([kinds.setdefault(d.shape, len(kinds)) for d in y[:m]], np.int64)
        samples = {d.shape: d for d in y[:m]}
        known: dict[int, np.ndarray] = {}

        def weights(i: int, upto: int) -> np.ndarray:
            c = x[i]
            if c.shape not in known:
                known[c.shape] = np.array([self.size(c, samples[k]) for k in kinds], np.int64)
            return known[c.shape][kind[:upto]]

        def below(above: np.ndarray, i: int) -> np.ndarray:
            w = weights(i, len(above) - 1)
            row = above.copy()
            np.maximum(row[1:], np.where(w > 0, above[:-1] + w, 0), out=row[1:])
            return np.maximum.accumulate(row)

        step = max(1, math.isqrt(n))
        starts, row = [], np.zeros(m + 1, np.int64)
        for i in range(n):
            if i % step == 0:
                starts.append(row)
            row = below(row, i)
        total += int(row[-1])
        i, j = n, m
        while i and j:
            first = (i - 1) // step * step
            rows = [starts[first // step][: j + 1]]
            for k in range(first, i):
                rows.append(below(rows[-1], k))
            while i > first and j:
                above, row = rows[i - first - 1], rows[i - first]
                c, d = x[i - 1], y[j - 1]
                w = int(known[c.shape][kinds[d.shape]])
                if w and row[j] == above[j - 1] + w:
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
                elif row[j] == above[j]:
                    i -= 1
                else:
                    j -= 1
        return pairs[::-1], total

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """Pairs of nodes that the alignment of the trees a and b puts at one place, from the roots down."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            yield a, b
            if a.children and b.children and self.size(a, b):
                x, y = a.children, b.children
                stack.extend((x[i], y[j]) for i, j in self._pairs[a.shape, b.shape])


#: How sure it has to be that a page has what k of n pages have, by the rule of succession.
SURE = 0.8
#: Places that hold less than this share of what the fullest beside them holds are no content.
LEAST_SHARE = 0.1
#: A level whose own texts, headings apart, are this share of what varies there is the content; so is one with a heading that varies.
OWN_TEXT = 0.05
#: Below this share of text outside of links, a place of the template is a list of links.
LEAST_TEXT = 0.3


def usual(k: int, n: int) -> bool:
    """Whether what stands in k of n pages is the template's: three pages are the least that can tell."""
    return (k + 1) / (n + 2) >= SURE


def induce(pages: list[Node]) -> None:
    """Finds the content of pages of one template: `slots` of each root where alignment tells, and below them the texts
    that are the template's (`fixed`).

    The reference is the page of median size. A text of it is constant if nearly all pages have it at the place that
    the alignment gives; of the elements, those that nearly all pages have are the template's places. From the root,
    `_content_places` goes down to the places that hold what varies.
    """
    n = len(pages)
    if not usual(n, n):
        return
    _mark_common(pages)
    matcher = Matcher()
    for p in pages:
        matcher.shape(p)
    reference = sorted(pages, key=_count)[n // 2]
    for p in pages:
        for a, b in matcher.pairs(reference, p):
            b.place = a
            a.at.append(b)
    for r in _nodes(reference):
        own = " ".join(r.text.split()) if r.tag == "#" else ""
        if own:
            equal = [x for x in r.at if " ".join(x.text.split()) == own]
            for x in equal if usual(len(equal), n) else ():
                x.fixed = True
    for p in pages:
        _weigh(p)
    places, within, labels = _content_places(reference, n)
    wanted = {id(r) for r in places}
    for p in pages:
        slots = _slots(p, wanted, within, labels, n)
        if slots:
            p.slots = [x for x, _ in slots]
            for x, marked in slots:
                _settle(x, marked)


def _nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node.children))


def _mark_common(pages: list[Node]) -> None:
    """Gives texts that at least half of the pages have a mark each, so that alignment prefers to pair them."""
    held: dict[str, int] = {}
    texts = [[(x, t) for x in _nodes(p) if x.tag == "#" and (t := " ".join(x.text.split()))] for p in pages]
    for own in texts:
        for t in {t for _, t in own}:
            held[t] = held.get(t, 0) + 1
    marks = {t: k + 1 for k, t in enumerate(t for t, k in held.items() if 2 * k >= len(pages))}
    for own in texts:
        for x, t in own:
            x.mark = marks.get(t, 0)


def _weigh(root: Node) -> None:
    """Characters that vary below each node, outside of links (`content`) and in them; what is left out has none for those above."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        if node.tag == "#" and not node.fixed:
            size = len(" ".join(node.text.split()))
            node.content, node.links = (0, size) if linked else (size, 0)
        stack.extend((c, linked or node.tag == "a") for c in node.children)
    for node in reversed(order):
        for c in node.children:
            if not c.skip:
                node.content += c.content
                node.links += c.links


def _content_places(reference: Node, n: int) -> tuple[list[Node], Node | None, set[str]]:
    """(places of the reference that hold the content, the place around them, labels): a child of that place without a
    place of its own in the template is content too if it has one of the labels, as one more of a list of records.

    From the root it goes down to the fullest place, but not into an article or main element. A level with headings or much
    text of its own that varies is the content as a whole; of other levels, places that hold little beside the fullest are
    left behind.
    """
    node = reference
    while True:
        whole = sum(x.content for x in node.at)
        if not whole:
            return [], None, set()
        if node.tag in ("article", "main"):
            return [node], None, set()  # what the pages call their article is content whole, small and linked parts too
        total = {id(c): sum(x.content for x in c.at) for c in node.children}
        here = [c for c in node.children if c.tag != "#" and not c.skip and usual(len(c.at), n)]
        boxes = [c for c in here if c.tag in CONTAINERS]
        lists = [c for c in boxes if c.tag not in ("article", "main") and total[id(c)] < LEAST_TEXT * (total[id(c)] + sum(x.links for x in c.at))]
        full = [c for c in boxes if c not in lists and total[id(c)]]
        best = max(full, key=lambda c: total[id(c)], default=None)
        heading, records = any(c.tag in HEADINGS and total[id(c)] for c in here), 0
        for x in node.at if best else ():
            for c in x.children:
                if not c.skip and (c.place is None or not usual(len(c.place.at), n)):
                    records += c.content if c.label == best.label else 0
                    heading = heading or c.tag in HEADINGS and c.content > 0
        own = whole - records - sum(total[id(c)] for c in boxes)
        if best is None or heading or own >= OWN_TEXT * whole:
            marked = [r for r in _outermost(node) if not r.skip and usual(len(r.at), n)]
            if node.tag not in ("article", "main") and 2 * sum(x.content for r in marked for x in r.at) >= whole:
                return marked, None, set()  # what the pages themselves call their article is most of it
            for c in lists:
                for x in c.at:
                    x.skip = LEFT_OUT
            return [node], None, set()
        kept = [c for c in full if c.label == best.label or total[id(c)] >= LEAST_SHARE * total[id(best)]]
        if len(kept) == 1 and not records:
            node = best
            continue
        marked = [c for c in kept if c.tag in ("article", "main") or any(True for _ in _outermost(c))]
        return marked or kept, node, {best.label} if best in (marked or kept) else set()


def _slots(root: Node, wanted: set[int], within: Node | None, labels: set[str], n: int) -> list[tuple[Node, bool]]:
    """The nodes of a page that stand at the content's places, in page order, and whether each is an article, holds one or is in one."""
    found, stack = [], [(root, False, False)]
    while stack:
        node, marked, beside = stack.pop()
        marked = marked or node.tag in ("article", "main")
        record = beside and not node.skip and node.label in labels and (node.place is None or not usual(len(node.place.at), n))
        if record or id(node.place) in wanted and node.place is not None:
            found.append((node, marked or any(True for _ in _outermost(node))))
        elif not node.skip:
            stack.extend((c, marked, within is not None and node.place is within) for c in reversed(node.children))
    return found


LISTED = frozenset("li td th tr dd dt".split())


def _settle(slot: Node, marked: bool) -> None:
    """Decides on the constant texts of a slot: a block of them stays the template's (`fixed`) unless it is the article's own.

    It is where a neighbour of its kind varies (a sentence that a host's articles share), or where it heads what varies;
    outside of articles that call themselves so, it has to stand between such neighbours, unless it is a list's item.
    Of a block of which a part varies, nothing is the template's, nor of a slot in which nothing varies.
    """
    if not slot.content + slot.links:
        _free(slot)
        return
    stack = [slot]
    while stack:
        node = stack.pop()
        own, kids, inline = [], [], list(reversed(node.children))
        while inline:  # the node's own text, and the blocks in it
            x = inline.pop()
            if x.tag == "#":
                own.append(x)
            elif not x.skip:
                if x.tag in BLOCKS:
                    kids.append(x)
                else:
                    inline.extend(reversed(x.children))
        if any(x.text.strip() and not x.fixed for x in own):
            for x in own:
                x.fixed = False
        varies = [bool(k.content + k.links) for k in kids]
        labels: dict[str, int] = {}
        for k, v in zip(kids, varies):
            labels[k.label] = labels.get(k.label, 0) + v
        first = varies.index(True) if any(varies) else len(kids)
        last = len(kids) - 1 - varies[::-1].index(True) if any(varies) else -1
        for i, k in enumerate(kids):
            if varies[i]:
                stack.append(k)
            else:
                before, after, same = first < i, last > i, labels[k.label] > 0
                if same and (marked or k.tag in LISTED or before and after) or k.tag in HEADINGS and after and (marked or before):
                    _free(k)


def _free(node: Node) -> None:
    for x in _nodes(node):
        x.fixed = False


def _count(root: Node) -> int:
    n, stack = 0, [root]
    while stack:
        node = stack.pop()
        n += 1
        stack.extend(node.children)
    return n


def main_text(root: Node) -> str:
    """The content's blocks: those of the slots that alignment found; else within article or main elements where there
    are such, or in the whole body."""
    tops = root.slots or [x for x in _outermost(root) if not x.skip] or [root]
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    for top in tops:
        stack: list[Node | None] = [top]
        while stack:
            node = stack.pop()
            if node is None:
                end()
            elif node.tag == "#":
                if not (node.fixed and root.slots):
                    line.append(node.text)
            elif not node.skip or node is top:
                if node.tag == "br":
                    line.append(" ")
                if node.tag in BLOCKS:
                    end()
                    stack.append(None)
                stack.extend(reversed(node.children))
        end()
    return "\n\n".join(blocks)


def _outermost(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            yield node
        elif not node.skip:
            stack.extend(reversed(node.children))


def texts_of(pages: list[str], templated: bool) -> list[str]:
    """The main text of each page of a block, in any order of them; the template is taken off if `templated`.

    Pages of which nothing but what is left out anyway differs are copies: one of them takes part, for all.
    """
    trees = {source: parse(source) for source in sorted(set(pages))}
    plain = {source: main_text(tree) for source, tree in trees.items()}
    if not templated:
        return [plain[source] for source in pages]
    first: dict[str, Node] = {}
    for source, tree in trees.items():
        first.setdefault(plain[source], tree)
    induce(list(first.values()))
    text = {whole: main_text(tree) or whole for whole, tree in first.items()}
    return [text[plain[source]] for source in pages]


BLOCK_PAGES = 48
#: Pages with more equal rows on their host than this are read once, and their text is joined to those rows.
MOST_COPIES = 16
#: Bytes of such pages' texts that are broadcast at most, if not the longest alone has more.
MOST_TEXT = 32 << 20
EXTRACTED = "text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """pages (with url and html) plus text and n_chars, replacing columns of these names; others pass through.

    A null html is an empty page with empty text. Pages are grouped by host; a host with many different pages is
    dealt into blocks of about BLOCK_PAGES by a hash of html, so a hot host is as many tasks' work as it has blocks,
    and each block induces its wrapper from its own pages. Pages without a host (a null url, or one without ://) and
    those of blocks of one or two different pages have nothing to be compared with: there the page's own article or
    main element counts, else all but what its elements and classes mark. Malformed markup is read as browsers would,
    nearly; elements nest 512 deep. Within article and main elements no part is left out for being small or a link; where a
    host has no such elements, places that hold less than LEAST_SHARE of what the fullest beside them holds are. Rows with equal html on one host are one page in this: it counts once, and they
    all get its text; where they are many they don't meet in one task. Such pages are told apart by 64-bit hashes
    within their host. Memory is one block's trees and rows.
    """
    keep = pages.drop("text", "n_chars")
    schema = plus(keep, EXTRACTED)
    host, page, block, lead, rows_, blocks = free(keep, "host", "page", "block", "lead", "rows", "blocks")
    at = keep.withColumn(host, host_of(F.col("url"))).withColumn(page, F.xxhash64(F.coalesce("html", F.lit(""))))
    counted = table(at.groupBy(host, page).agg(F.count("*").alias(rows_)), "pages")
    large = table(counted.groupBy(host).agg(F.ceil(F.count("*") / BLOCK_PAGES).alias(blocks)).where(F.col(blocks) > 1), "hosts")
    hosts = bounded(large)

    def dealt(rows: DataFrame) -> DataFrame:
        found = rows.join(hosts, host, "left")
        return found.withColumn(block, F.xxhash64(host, F.pmod(page, F.coalesce(blocks, F.lit(1))))).select(*rows.columns, block)

    def read(rows: DataFrame, out: StructType, leads: bool) -> DataFrame:
        rows = rows.repartition(block).sortWithinPartitions(block)
        return rows.mapInArrow(lambda batches: _read(batches, out.names, leads, block, host, lead), out)

    often = table(counted.where(F.col(rows_) > MOST_COPIES), "copied")
    if often.isEmpty():
        rows = dealt(at).select(*keep.columns, host, page, block, F.lit(False).alias(lead))
        return read(rows, schema, False)
    # one row of each page with many copies takes part in its block
    named = bounded(often.drop(rows_))
    copied = at.join(named, [host, page], "left_semi")
    leads = table(dealt(copied.select(host, page, "html").dropDuplicates([host, page])), "leads")
    rare = dealt(at.join(named, [host, page], "left_anti"))
    own = [F.col("html") if c == "html" else F.lit(None).cast(keep.schema[c].dataType).alias(c) for c in keep.columns]
    ends = [host, page, block]
    rows = rare.select(*keep.columns, *ends, F.lit(False).alias(lead)).unionByName(leads.select(*own, *ends, F.lit(True).alias(lead)))
    # their texts come from the blocks that they are in
    beside = rare.select("html", *ends).join(bounded(table(leads.select(block).distinct(), "blocks")), block, "left_semi")
    voters = beside.select("html", *ends, F.lit(False).alias(lead)).unionByName(leads.select("html", *ends, F.lit(True).alias(lead)))
    texts = table(read(voters, StructType([*leads.select(host, page).schema.fields, *StructType.fromDDL(EXTRACTED).fields]), True), "texts")
    key = F.xxhash64(host, page)
    texts = texts.join(bounded(often), [host, page]).select(key.alias(block), rows_, "text", "n_chars")
    longest = texts.agg(F.max(F.octet_length("text"))).first()[0] or 0
    copies = look_up(copied.withColumn(block, key), texts, block, rows_, "inner", max(1, MOST_TEXT // (longest + 100)))
    return read(rows, schema, False).unionByName(copies.select(*keep.columns, "text", "n_chars"))


def _read(batches: Iterator[pa.RecordBatch], names: list[str], leads: bool, block: str, host: str, lead: str) -> Iterator[pa.RecordBatch]:
    """The named columns of rows sorted by block, with texts; of leading rows if `leads`, else of the others."""
    held: list[pa.RecordBatch] = []

    def blocks_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(batch.schema.get_field_index(block)).to_numpy()

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        blocks, hosts, htmls = (t.column(c).to_pylist() for c in (block, host, "html"))
        texts: list[str] = []
        start = 0
        for i in range(1, len(blocks) + 1):
            if i == len(blocks) or blocks[i] != blocks[start]:
                texts += texts_of([x or "" for x in htmls[start:i]], bool(hosts[start]))
                start = i
        made = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}
        out = pa.table([made[c] if c in made else t.column(c) for c in names], names=names)
        out = out.filter(t.column(lead) if leads else pc.invert(t.column(lead))).combine_chunks()
        return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in out.columns], names=names)

    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            batch = whole.slice(i, 256)
            own = blocks_of(batch)
            cut = int((own == own[-1]).argmax())  # the last block may go on
            if cut:
                held.append(batch.slice(0, cut))
                yield flush()
            elif held and blocks_of(held[-1])[-1] != own[0]:
                yield flush()
            held.append(batch.slice(cut))
    if held:
        yield flush()


def op7_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
