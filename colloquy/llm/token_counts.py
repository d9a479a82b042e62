"""Token counts by a two-tier lookup of pre-token lengths, with nothing shuffled.

A text falls into pre-tokens that no merge of the model can cross, so its count is the sum of theirs. Lengths of
frequent pre-tokens come to every worker in one small broadcast table; others are encoded once per worker and kept
in a bounded cache.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .scratch import lean, plus

SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Spaces and then a run of Latin letters or of other characters, a line end, or spaces before one or at the end.
PRE_TOKEN = re.compile(f"{SPACE}*(?:[{LATIN}]+|[^{LATIN}{SPACE}\n]+)|\n|{SPACE}+")
#: What no piece may hold, so that no merge crosses two pre-tokens.
CROSSING = re.compile(f"[^{SPACE}]{SPACE}|\n.|.\n|[{LATIN}][^{LATIN}{SPACE}]|[^{LATIN}{SPACE}][{LATIN}]", re.S)


class PieceModel:
    """A sentencepiece BPE model without normalisation, with the dummy space before a text taken out of its encoder."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        crossing = [p.piece for p in proto.pieces if p.type == 1 and CROSSING.search(p.piece)]
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or crossing or any(p.type == 4 for p in proto.pieces):
            raise ValueError("this model's pieces can cross pre-tokens")
        proto.normalizer_spec.add_dummy_prefix = False
        self._processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def pre_tokens(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return PRE_TOKEN.findall(SPACE + text if self.prefix else text)

    def length(self, pre_token: str) -> int:
        return len(self._processor.encode(pre_token))


class Lengths(dict):
    """Pre-token lengths: the frequent ones that are given, and a cache of at most `room` others."""

    def __init__(self, model: PieceModel, frequent: dict[str, int], room: int = 400_000, longest: int = 48):
        super().__init__(frequent)
        self._model, self._frequent, self._most, self._longest = model, frequent, len(frequent) + room, longest

    def __missing__(self, pre_token: str) -> int:
        n = self._model.length(pre_token)
        if len(pre_token) <= self._longest:
            if len(self) >= self._most:
                self.clear()
                self.update(self._frequent)
            self[pre_token] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self._model.pre_tokens(text or "")))


def frequent_lengths(docs: DataFrame, model_path: str, sample_docs: int = 2048, entries: int = 1 << 15, parts: int = 8) -> tuple[bytes, bytes]:
    """The table's compact form: pre-tokens joined by line ends, and their lengths as 16-bit numbers.

    It holds the `entries` most frequent pre-tokens of about `sample_docs` texts, so its size is bounded (about 1 MB)
    whatever the input. The texts are drawn evenly from all rows of `parts` partitions that are drawn by lot; only
    these are read, and nothing is shuffled. It only saves work: no count depends on what it holds.
    """
    each = -(-sample_docs // parts)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dice, drawn, met = random.Random(11), [], 0
        for batch in batches:
            for i in range(batch.num_rows):  # a reservoir: each row so far is in with the same chance
                met += 1
                k = len(drawn) if len(drawn) < each else dice.randrange(met)
                if k < each:
                    drawn[k : k + 1] = [batch.column(0)[i].as_py()]
        model, seen = PieceModel(model_path), Counter()
        for text in drawn:
            seen.update(x for x in model.pre_tokens(text or "") if len(x) <= 64 and x != "\n")
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_pydict({"x": pa.array([x for x, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    found = docs.select("text").mapInArrow(tally, "x string, n long").rdd
    n = found.getNumPartitions()
    if not n:
        return b"", b""
    seen: Counter = Counter()
    for row in docs.sparkSession.sparkContext.runJob(found, list, sorted(random.Random(7).sample(range(n), min(n, parts)))):
        seen[row["x"]] += row["n"]
    model = PieceModel(model_path)
    top = [x for x, _ in sorted(seen.items(), key=lambda e: (-e[1], e[0]))[:entries]]
    return "\n".join(top).encode(), np.array([model.length(x) for x in top], np.uint16).tobytes()


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, sample_docs: int = 2048) -> DataFrame:
    """docs (with a column text) plus n_bytes, n_tokens and over_limit, replacing columns of these names.

    A null text counts as empty and has no token. Repeated rows are counted each. The file at model_path must be
    on every executor. Only the table of frequent pre-tokens is broadcast.
    """
    keep = docs.drop("n_bytes", "n_tokens", "over_limit")
    schema = plus(keep, "n_bytes long, n_tokens long, over_limit boolean")
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_path, sample_docs))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lengths = sent.value
        frequent = dict(zip(names.decode().split("\n"), np.frombuffer(lengths, np.uint16).tolist())) if names else {}
        table = Lengths(PieceModel(model_path), frequent)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            n = np.array([table.count(t) for t in texts.to_pylist()], np.int64)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size, pa.array(n), pa.array(n > limit)], names=schema.names)

    return keep.mapInArrow(run, schema)


def op4_two_tier_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
