"""Ordered rewrite rules as data: a plan names a list of rules, and workers apply it to whole Arrow batches.

Each rule rewrites what the last one left. Most rules begin with plain characters; a text without those is passed by.
The steps are marked as not deterministic, though they are: so the optimizer runs each once and moves none into a lambda,
where Python can't be called.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column

from .. import lexicons as L
from .rowwise import by_row
from .tokens import within_latin


def beginning(pattern: str) -> str:
    """Characters that stand in every match of the pattern: the plain ones that it begins with; '' if that can't be told."""
    if "|" in pattern:
        return ""
    plain = re.match(r"\^?([^\\\[\](){}.*+?^$]*)", pattern)
    return plain[1][:-1] if pattern[plain.end() : plain.end() + 1] in ("*", "?", "{") else plain[1]


def beyond(pattern: str) -> bool:
    """Whether every match of the pattern surely has a sign beyond Latin-1: in its beginning, or in a class that it begins with."""
    if any(c > "\xff" for c in beginning(pattern)):
        return True
    pattern = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), pattern)
    times = r"(?:\{[1-9]\d*,?\d*\}|(?![*?{]))"
    first = re.match(rf"\[([^\]\\^]+)\]{times}|\(\[([^\]\\^]+)\]{times}\)(?![*?{{])", pattern)
    return "|" not in pattern and first is not None and all(c > "\xff" for c in (first[1] or first[2]).replace("-", ""))


def signs(pattern: str) -> str:
    """The signs of Latin-1 with which a match in a text of such signs can begin, where the pattern begins with a class that lists them; '' if that can't be told."""
    first = re.match(r"\[((?:[^\]\\^-]|\\[\\'\"])+)\](?![*?]|\{0)", pattern)
    return "" if "|" in pattern or first is None else "".join(c for c in dict.fromkeys(re.sub(r"\\(.)", r"\1", first[1])) if c <= "\xff")


def quick(pattern: str) -> str:
    """The same pattern, where it begins with a repeated class, so that the class's signs are what is searched for."""
    return re.sub(r"^(\[[^\]\\]+\])\{2,\}(?![?+])", r"\1\1+", pattern)


class Rules:
    """(pattern, replacement) pairs, applied in order to a text without white space at its ends, which then go again.

    While a text has no sign beyond Latin-1, rules that need one are passed by.
    """

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self._rules = [(beginning(p), re.compile(quick(p)), r) for p, r in rules]
        self._latin = [(k, signs(p) or (plain,), pattern, r) for k, ((plain, pattern, r), (p, _)) in enumerate(zip(self._rules, rules)) if not beyond(p)]

    def __call__(self, text: str) -> str:
        text, rest = text.strip(), self._rules
        if within_latin(text):
            rest = []
            for k, begins, pattern, replacement in self._latin:
                for sign in begins:
                    if sign in text:
                        text = pattern.sub(replacement, text)
                        break
                else:
                    continue
                if not within_latin(text):
                    rest = self._rules[k + 1 :]
                    break
        for plain, pattern, replacement in rest:
            if plain in text:
                text = pattern.sub(replacement, text)
        return text.strip()


NAMED: dict[str, Callable[[], Sequence[tuple[str, str]]]] = {
    "narrated": lambda: [*((p, "") for p in L.GREETINGS), *L.NARRATIVE_FIRST, *L.NARRATIVE_ROLES, *L.NARRATIVE_LAST],
    "tidied": lambda: [*((p, "") for p in (*L.SUMMARY_OPENINGS, *L.SUMMARY_ENDINGS)), *L.SUMMARY_PHRASES],
}


@functools.cache
def named(name: str) -> Rules:
    return Rules(NAMED[name]())


def rewrite(text: str | None, names: Sequence[str]) -> str | None:
    for name in names:
        text = text if text is None else named(name)(text)
    return text


def rewritten(c: Column, *names: str) -> Column:
    """A text after these lists of rules, one after the other; null stays null."""
    return by_row("string", lambda t: rewrite(t, names), c)


def all_rewritten(c: Column, *names: str) -> Column:
    """Every text of an array after these lists of rules."""
    return by_row("array<string>", lambda every: None if every is None else [rewrite(t, names) for t in every], c)


def narrated(c: Column) -> Column:
    """A sentence as a report tells it: greetings and connectives go, the first person becomes a role."""
    return rewritten(c, "narrated")


def tidied(c: Column) -> Column:
    """A summary sentence without spoken openings and endings, repeats and filler."""
    return rewritten(c, "tidied")
