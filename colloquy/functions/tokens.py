"""Word segmentation of Chinese text: longest match over a lexicon, in Arrow batches. For a corpus whose words were learned, see `operators.lexicon`.

The steps are marked as not deterministic, though they are: else the optimizer copies what lies below them into each use.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column

from .. import lexicons as L
from .rowwise import by_row

#: A run of Chinese signs, of other letters, of white space, or another character.
RUN = re.compile(r"[一-龥]+|[^\W一-龥]+|\s+|.", re.S)
#: The words of `segment` of two signs or more in a text within Latin-1.
_LATIN_LONG = re.compile(r"\w{2,}|\s{2,}")


def within_latin(text: str) -> bool:
    """Whether all signs are of Latin-1, so that none is Chinese."""
    try:
        return text.isascii() or text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


def is_word_sign(c: str) -> bool:
    return "一" <= c <= "龥"


def default_lexicon() -> dict[str, str]:
    """Words that the other tables name, with a part of speech: n unless a table says otherwise."""
    tagged = {w: "n" for words in L.TOPICS.values() for w in words}
    for words, tag in ((L.STOP_WORDS_ZH, "u"), (L.DOMAIN_STOP_WORDS_ZH, "n"), (L.NEUTRAL_WORDS, "n"), (L.POSITIVE_WORDS, "v"), (L.NEGATIVE_WORDS, "v"), (L.DEGREE_WORDS, "d"), (L.NEGATION_WORDS, "d"), (L.HIGH_RISK_WORDS, "v"), (L.MEDIUM_RISK_WORDS, "v")):
        tagged |= {w: tag for w in words if w not in tagged}
    for w in "保本 收益 保收益 保本保收益 零风险 承诺 风险告知 告知 测评 理财 投资者 适当性 销售 录音 录像 员工 团队 公司 工作 合作".split():
        tagged.setdefault(w, "n")
    return tagged


def segment(text: str, lexicon: Iterable[str], longest: int) -> list[str]:
    """Words by forward longest match; a character that begins no word stands alone, other runs stay whole."""
    out = []
    for run in RUN.findall(text):
        if not is_word_sign(run[0]):
            out.append(run)
            continue
        i = 0
        while i < len(run):
            n = next((n for n in range(min(longest, len(run) - i), 1, -1) if run[i : i + n] in lexicon), 1)
            out.append(run[i : i + n])
            i += n
    return out


def long_words(text: str, lexicon: Iterable[str], longest: int) -> list[str]:
    """The words of `segment` that have more than one sign, in order."""
    if within_latin(text):
        return _LATIN_LONG.findall(text)
    return [w for w in segment(text, lexicon, longest) if len(w) > 1]


def tokens(text: Column, lexicon: Iterable[str] | None = None) -> Column:
    """Words of Chinese or mixed text, in order. The lexicon goes along with the function."""
    known = frozenset(lexicon if lexicon is not None else default_lexicon())
    longest = max(map(len, known), default=1)

    return by_row("array<string>", lambda t: segment(t, known, longest) if t else [], text)


def tagger(lexicon: dict[str, str] | None = None) -> Callable[[str | None], list[tuple[str, str]]]:
    """What tells the (word, tag) pairs of a text, as `tagged` has them."""
    known = dict(lexicon if lexicon is not None else default_lexicon())
    longest = max(map(len, known), default=1)
    return lambda t: [(w, known.get(w, "n" if is_word_sign(w[0]) else "eng")) for w in segment(t or "", known, longest)]


def tagged(text: Column, lexicon: dict[str, str] | None = None) -> Column:
    """(word, tag) of Chinese or mixed text, in order; words of the lexicon have its tag, other characters n, other runs eng."""
    return by_row("array<struct<word: string, tag: string>>", tagger(lexicon), text)
