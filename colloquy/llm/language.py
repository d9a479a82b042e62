"""Language identification by compression.

Each language has a raw-content zstandard dictionary: some of its texts, joined. A text is cut into pieces of a
few kilobytes, every piece is compressed with every dictionary, and the language whose dictionary gives the
fewest bytes over all pieces wins. Where the best two are too close for the length, the text is marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import lean, plus

PIECE, LEVEL = 2048, 6
#: Each piece is compressed so many times over, in one go: else zstandard stores a piece of few words as it is, whatever
#: the dictionary. The later copies cost one match each.
REPEATS = 4
_LETTERS = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    """The text in lower case, in UTF-8, with one space for whatever ASCII characters are no letters."""
    return b" ".join([b"", *text.lower().encode("utf-8", "replace").translate(_LETTERS).split(), b""])


class Languages:
    """Compressors for each language, made once in every Python worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)  # by falling number of training rows; ties go to the first
        self._coders = [self._coder(d) for d in dictionaries.values()]

    @staticmethod
    def _coder(content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text with each language's dictionary."""
        raw = plain(text)
        step = -(-len(raw) // -(-len(raw) // PIECE))
        found = [0] * len(self._coders)
        for i in range(0, len(raw), step):
            piece = raw[i : i + step] * REPEATS
            for k, c in enumerate(self._coders):
                found[k] += len(c.compress(piece))
        return found

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected). `und` with score 0, rejected, if text is null or has no letter.

        score is how far the runner-up is behind as a share of its bytes, 0 to 1; it is below `margin` for a
        rejected text. Ties go to the language with more training rows and have score 0.
        """
        if text is None or not self.names or not _LETTER.search(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(sizes) == 1:
            return self.names[best], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        score = (second - sizes[best]) / max(1, second)
        return self.names[best], score, score < margin


def training_rows(docs: DataFrame) -> Column:
    """True for the rows that a classifier may learn from: crc32 of doc_id's text leaves another remainder than 2 by 4."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


#: Bytes of all dictionaries together, which go to every worker, and the least that a language is learned from.
MOST_BYTES, LEAST_BYTES = 64 << 20, 16 << 10


def learn(docs: DataFrame, sample_docs: int = 192, dictionary_bytes: int = 112 << 10, excerpt: int = 3 << 10) -> dict[str, bytes]:
    """Dictionaries from a bounded sample: per language about `sample_docs` different texts of `training_rows`, until
    they fill `dictionary_bytes` (less where so many languages would make more than MOST_BYTES together).

    The languages are all values of lang among those rows; their counts come from all rows; more than MOST_BYTES /
    LEAST_BYTES = 4,096 are an error. Of a text with more characters than `excerpt` a stretch of that length counts,
    at a place that a hash of the text deals. Rows join the sample by a hash of that stretch, with a chance from the
    number of different ones that the language has (estimated to some 5%), so that the expected size is the same for
    any number of rows, however many of them are copies; where there are few all are in. Equal rows give equal dictionaries.
    """
    place = F.pmod(F.xxhash64("text", F.lit(5)), F.greatest(F.char_length("text") - excerpt + 1, F.lit(1)))
    rows = docs.where(training_rows(docs)).select("lang", F.substr("text", (place + 1).cast("int"), F.lit(excerpt)).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text", F.lit(17)))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("texts")).limit(MOST_BYTES // LEAST_BYTES + 1).collect()
    if len(found) > MOST_BYTES // LEAST_BYTES:
        raise ValueError(f"more than {MOST_BYTES // LEAST_BYTES} values of lang: this is no column of languages")
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return {}
    dictionary_bytes = min(dictionary_bytes, MOST_BYTES // len(counts))
    share = F.lit(None).cast("double")
    for r in found:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 6 * sample_docs / max(1, r["texts"])))).otherwise(share)
    chosen = rows.select("lang", "text", F.pmod("hash", F.lit(1 << 30)).alias("dice")).where(F.col("dice") < share * float(1 << 30))
    chosen = chosen.dropDuplicates(["lang", "text"])
    chosen = chosen.groupBy("lang").agg(F.expr(f"slice(sort_array(collect_list(struct(dice, text))), 1, {sample_docs})").alias("rows"))
    found = {}
    for row in sorted(chosen.collect(), key=lambda r: (-counts[r["lang"]], r["lang"])):
        parts, size = [], 0
        for r in row["rows"]:
            raw = plain(r["text"])
            if size + len(raw) <= dictionary_bytes:
                parts.append(raw)
                size += len(raw)
        if size >= 8:  # zstandard takes no shorter content
            found[row["lang"]] = b"".join(parts)
    return found


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.002) -> DataFrame:
    """docs (with a column text) plus lang_pred, score and rejected, replacing columns of these names.

    Null and empty texts and those without a letter get `und`; equal texts get equal predictions; other columns
    pass through. Only the text decides. The dictionaries are broadcast once; `learn` bounds their size.
    """
    keep = docs.drop("lang_pred", "score", "rejected")
    schema = plus(keep, "lang_pred string, score double, rejected boolean")

    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(sent.value)
        for batch in batches:
            said = [languages.predict(t, margin) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            columns = [*batch.columns, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()), pa.array([x[2] for x in said], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return keep.mapInArrow(run, schema)


def op2_language_by_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    said = identify(docs.select("doc_id", "text"), learn(docs))
    return said.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
