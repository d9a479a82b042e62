"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

The merge list tells how far to the right of a token its fate can depend (`sufficient_lookahead`). A pre-token is
read piece by piece; tokens that end at least that far before the end of what is read are final and leave the
buffer. Texts are normalised and cut into pre-tokens block by block; a pre-token that a block's end cuts goes on
through the transducer. So beside the text itself, and ids that are asked for, memory does not grow with the length of
a pre-token or a text.
"""

from __future__ import annotations

import array
import codecs
import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .scratch import lean, plus

#: White space as Unicode defines the property.
WHITE = "\t-\r \x85\xa0  -     　"
_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
#: The same for texts whose characters all come before U+0180: letters and numbers in ranges.
_LOW_LETTERS, _LOW_NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
_LOW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOW_LETTERS}]+|[{_LOW_NUMBERS}]|[^\t-\r \x85\xa0{_LOW_LETTERS}{_LOW_NUMBERS}]+")
_NOT_LOW = re.compile("[İƀ-\U0010ffff]")
#: Characters that are normalised at a time, about; and how far back from a block's end a place to cut is looked for.
BLOCK, LOOK_BACK = 1 << 16, 1 << 12
_WHITE = re.compile(f"[{WHITE}]")
_LETTER = regex.compile(r"\p{L}")
_NUMBER = regex.compile(r"\p{N}")


def byte_letters() -> dict[int, str]:
    """A printable character for each byte, as byte-level vocabularies write them."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[str, str]], end: str) -> int:
    """How many characters beyond a token's end decide whether that token stands.

    A merge (u, v) needs v to be left alone by every earlier merge (v, x); that one depends in turn on what x
    meets, and so on along earlier and earlier merges. Going up the list, `pull[v]` keeps the farthest reach of the
    merges that would take v to its right, so each merge's own reach is known when it comes.
    """
    pull: dict[str, int] = {}
    reach: dict[str, int] = {}
    size = lambda t: len(t.removesuffix(end)) if end else len(t)
    for u, v in merges:
        r = max(reach.get(v, 0), pull.get(v, 0))
        reach[u + v] = max(reach.get(u + v, 0), r)
        pull[u] = max(pull.get(u, 0), size(v) + r)
    return max([1, *reach.values(), *pull.values()])


class WordBPE:
    """What a tokenizer file of this kind says: NFC and lower case, split by a pattern, bytes as letters, merges with a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        steps = [x["type"] for x in said["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or said["decoder"] is not None or model["unk_token"] or model["dropout"]:
            raise ValueError("not a tokenizer of the kind that this transducer models")
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, self.end)
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._letter = byte_letters()
        self.byte = {c: b for b, c in self._letter.items()}

    def merged(self, symbols: list[str]) -> list[str]:
        """The tokens that the merges make of symbols: lowest rank first, then leftmost."""
        n = len(symbols)
        if n < 32:
            return self._merged_short(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        at: list[str | None] = list(symbols)
        while heap:
            _, i, u, v = heapq.heappop(heap)
            j = after[i]
            if at[i] != u or j >= n or at[j] != v:
                continue
            at[i], at[j] = u + v, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((at[i], at[k]))) is not None:
                    heapq.heappush(heap, (r, i, at[i], at[k]))
            if (h := before[i]) >= 0 and (r := rank.get((at[h], at[i]))) is not None:
                heapq.heappush(heap, (r, h, at[h], at[i]))
        return [t for t in at if t is not None]

    def _merged_short(self, symbols: list[str]) -> list[str]:
        """The same for few symbols, by looking for the best pair again and again."""
        rank, far = self.rank.get, len(self.rank)
        ranks = [rank(pair, far) for pair in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < far:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), far)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), far)
        return symbols

    def encode_stream(self, pieces: Iterable[bytes], step: int = 512) -> Iterator[list[int]]:
        """Ids of one pre-token whose bytes come in pieces, as they become final."""
        at = Transducer(self, step)
        for piece in pieces:
            if ids := at.feed(piece):
                yield ids
        yield at.close()

    def parts(self, text: str) -> Iterator[list[str] | int | Piece]:
        """What the text falls into, in order: lists of whole pre-tokens, ids of special strings, and pieces of pre-tokens that go over blocks."""
        start = 0
        for m in self._special.finditer(text) if self._special else ():
            yield from self._plain_parts(text[start : m.start()])
            yield self.special[m[0]]
            start = m.end()
        yield from self._plain_parts(text[start:] if start else text)

    def _plain_parts(self, text: str) -> Iterator[list[str] | Piece]:
        open_ = ""
        for block, goes_on in blocks(text):
            if _NOT_LOW.search(block):
                block = unicodedata.normalize("NFC", block)
                found = _ANY.findall("".join(map(str.lower, block)) if "Σ" in block else block.lower())
            else:
                found = _LOW.findall(block.lower())
            first, last = 0, len(found)
            if open_:
                same = bool(found) and run_of(found[0]) == open_
                if same:
                    first = 1
                if not same or last > 1 or not goes_on:
                    yield Piece(found[0] if same else "", True)
                    open_ = ""
                else:
                    yield Piece(found[0], False)
            if goes_on and last > first and (run := run_of(found[-1])):
                yield found[first:-1]
                yield Piece(found[-1], False)
                open_ = run
            elif last > first:
                yield found[first:] if first else found
        if open_:
            yield Piece("", True)


class Piece:
    """A part of a pre-token; the last one says so. The first follows whatever is no piece, or a last one."""

    __slots__ = ("text", "last")

    def __init__(self, text: str, last: bool):
        self.text, self.last = text, last


class Transducer:
    """One pre-token's bytes in, final ids out; at most lookahead + step letters and a piece are held."""

    def __init__(self, model: WordBPE, step: int = 512):
        self._model, self._step = model, step
        self._held: list[str] = []

    def feed(self, piece: bytes) -> list[int]:
        model, ids = self._model, []
        for k in range(0, len(piece), self._step):
            held = self._held
            held.extend(map(model._letter.__getitem__, piece[k : k + self._step]))
            if len(held) > model.lookahead + self._step:
                done = 0
                for token in model.merged(list(held)):
                    if done + len(token) > len(held) - model.lookahead - 1:  # the last letter may yet be a word end
                        break
                    ids.append(model.vocab[token])
                    done += len(token)
                del held[:done]
        return ids

    def close(self) -> list[int]:
        held, self._held = self._held, []
        if not held:
            return []
        held[-1] += self._model.end
        return [*map(self._model.vocab.__getitem__, self._model.merged(held))]


def run_of(pre_token: str) -> str:
    """Whether a pre-token is a run that may go on: of letters, or of signs; a number or a contraction is whole."""
    if _LETTER.match(pre_token):
        return "letters"
    if _NUMBER.match(pre_token) or pre_token[0] == "'" and len(pre_token) > 1 and _LETTER.match(pre_token[1]):
        return ""
    return "signs"


@functools.cache
def _second_of_pairs() -> frozenset[str]:
    """Characters, marks aside, that NFC may join to the one before."""
    own = {chr(c) for r in (range(0x1161, 0x1176), range(0x11A8, 0x11C3)) for c in r}
    for c in range(0xC0, 0x32000):
        pair = unicodedata.decomposition(chr(c)).split()
        if len(pair) == 2 and not pair[0].startswith("<"):
            own.add(chr(int(pair[1], 16)))
    return frozenset(own)


def may_cut(text: str, k: int) -> bool:
    """Whether a run may be cut before text[k]: no normal form and no contraction reaches over that place."""
    if "'" in text[k - 2 : k + 1] and text[k - 2 : k + 2] != "''''":
        return False
    if text[k] < "\x80":
        return True
    first = unicodedata.normalize("NFD", text[k])[0]
    return not unicodedata.combining(first) and first not in _second_of_pairs()


def blocks(text: str) -> Iterator[tuple[str, bool]]:
    """The text in blocks of about BLOCK characters, and whether a run may go on beyond each.

    A block ends before white space if there is some within LOOK_BACK, else where `may_cut` lets it. A longer run
    of marks or apostrophes alone stays in one block.
    """
    start = 0
    while len(text) - start > BLOCK:
        end = start + BLOCK
        low = max(start + 1, end - LOOK_BACK)
        cut = max((m.start() for m in _WHITE.finditer(text, low, end + 1)), default=0)
        goes_on = not cut
        if goes_on:
            cut = next((k for k in range(end, max(low, start + 2), -1) if may_cut(text, k)), 0)
            cut = cut or next((k for k in range(end + 1, len(text)) if _WHITE.match(text, k) or may_cut(text, k)), len(text))
            goes_on = cut < len(text) and not _WHITE.match(text, cut)
        yield text[start:cut], goes_on
        start = cut
    if start < len(text):
        yield text[start:], False


class Decoder:
    """From ids to text, one at a time.

    `spaced` is what a tokenizer without a decoder gives: the tokens with a space between them; the state is
    whether a token came before. `bytes` turns letters back to bytes and word ends to spaces; the state is the
    beginning of an unfinished UTF-8 character.
    """

    def __init__(self, model: WordBPE, form: str = "spaced"):
        self._model, self._form = model, form
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self._begun = False

    def reset(self) -> None:
        self._utf8.reset()
        self._begun = False

    def feed(self, ids: Iterable[int]) -> str:
        out = []
        for i in ids:
            token = self._model.name.get(i)
            if token is None:
                continue
            if self._form == "spaced":
                out.append(" " + token if self._begun else token)
                self._begun = True
            elif token in self._model.special:
                out.append(self._utf8.decode(b"", True) + token)
                self._utf8.reset()
            else:
                word_end = bool(self._model.end) and token.endswith(self._model.end)
                raw = bytes(self._model.byte[c] for c in (token.removesuffix(self._model.end) if word_end else token))
                out.append(self._utf8.decode(raw + b" " if word_end else raw))
        return "".join(out)

    def close(self) -> str:
        return self._utf8.decode(b"", True)


class Words(dict):
    """For pre-tokens: their ids as text, what these decode to (both in UTF-8), and the ids as 32-bit numbers. At most `room` are kept."""

    def __init__(self, model: WordBPE, room: int = 150_000, longest: int = 32):
        super().__init__()
        self._decoder = Decoder(model)
        self.model, self._room, self._longest = model, room, longest

    def __missing__(self, word: str) -> tuple[bytes, bytes, bytes]:
        at = Transducer(self.model)
        found = self.of(at.feed(word.encode("utf-8", "replace")) + at.close())
        if len(word) <= self._longest:
            if len(self) >= self._room:
                self.clear()
            self[word] = found
        return found

    def of(self, ids: list[int]) -> tuple[bytes, bytes, bytes]:
        self._decoder.reset()
        return " ".join(map(str, ids)).encode(), self._decoder.feed(ids).encode(), array.array("i", ids).tobytes()


class Sink:
    """Digests of a text's ids and of what they decode to, as they come; both themselves only if they are kept."""

    def __init__(self, keep_ids: bool = False, keep_decoded: bool = False):
        self.n, self._ids, self._decoded = 0, hashlib.sha256(), hashlib.sha256()
        self.ids = array.array("i") if keep_ids else None
        self.decoded: list[bytes] | None = [] if keep_decoded else None

    def add(self, ids: bytes, decoded: bytes, packed: bytes, begun: bool = False) -> None:
        """ids joined by spaces; decoded says what they are, with the space before them if a piece has `begun`."""
        if packed:
            if self.n:
                self._ids.update(b" ")
                decoded = decoded if begun else b" " + decoded
            self._ids.update(ids)
            self._decoded.update(decoded)
            self.n += len(packed) // 4
            if self.ids is not None:
                self.ids.frombytes(packed)
            if self.decoded is not None:
                self.decoded.append(decoded)

    def digests(self) -> tuple[str, str]:
        return self._ids.hexdigest(), self._decoded.hexdigest()


def transduce(text: str, words: Words, sink: Sink) -> None:
    """Sends the text's ids, and what they decode to, into sink."""
    at: Transducer | None = None
    for part in words.model.parts(text):
        if isinstance(part, int):
            sink.add(*words.of([part]))
        elif isinstance(part, Piece):
            if at is None:
                at, decoder, begun = Transducer(words.model), Decoder(words.model), False
            ids = at.feed(part.text.encode("utf-8", "replace")) + (at.close() if part.last else [])
            sink.add(" ".join(map(str, ids)).encode(), decoder.feed(ids).encode(), array.array("i", ids).tobytes(), begun)
            begun = begun or bool(ids)
            if part.last:
                at = None
        elif part:
            sink.add(*map(_join, (b" ", b" ", b""), zip(*map(words.__getitem__, part))))


def _join(between: bytes, parts: tuple[bytes, ...]) -> bytes:
    return between.join(parts)


def encode(docs: DataFrame, tokenizer_path: str, want: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """docs (with a column text) plus n_tokens, ids_sha256, decoded_sha256 and, of `want`, ids and decoded.

    Columns of these names are replaced, others pass through. A null text is as an empty one: no tokens, and the
    digests are those of empty text. Special strings within a text become their single ids. Digests are over the
    decimal ids and the decoded text, fed as tokens become final; equal texts give equal rows. A task holds a batch's
    rows, and of ids and decoded texts those of SLICE rows.
    """
    keep = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    wanted = [w for w in ("ids", "decoded") if w in want]
    schema = plus(keep, "n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join({"ids": ", ids array<int>", "decoded": ", decoded string"}[w] for w in wanted))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(WordBPE(tokenizer_path))
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                sinks = []
                for text in batch.column(batch.schema.get_field_index("text")):
                    sinks.append(Sink("ids" in wanted, "decoded" in wanted))
                    transduce(text.as_py() or "", words, sinks[-1])
                made = [pa.array([s.n for s in sinks], pa.int64()), *(pa.array(x, pa.string()) for x in zip(*[s.digests() for s in sinks]))]
                if "ids" in wanted:
                    ends = np.cumsum([0, *(s.n for s in sinks)])
                    made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.frombuffer(s.ids, np.int32) for s in sinks]))))
                if "decoded" in wanted:
                    made.append(pa.array([b"".join(s.decoded).decode() for s in sinks], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return keep.mapInArrow(run, schema)


SLICE = 64


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), want=()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
