import random
import zlib

import zstandard

from colloquy.llm import language as lang

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = {r["doc_id"]: r for r in lang.op2_language_by_compression(spark, SF).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(said) == len(rows)
    assert all(said[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if said[r["doc_id"]]["held_out"]]
    assert sum(said[r["doc_id"]]["lang_pred"] == r["lang"] for r in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in said.values())


def test_edges(spark):
    rows = [(1, "the cat and the dog are in the house of the man", "en"), (3, "der hund und die katze sind in dem haus", "de"), (None, None, None)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    d = lang.learn(docs)
    assert set(d) == {"en", "de"}
    given = [(1, None, 1.0), (2, "", 1.0), (3, "12 !? 34 ² ½ _", 1.0), (4, "the man and the dog", 2.0), (4, "the man and the dog", 2.0), (None, "die katze und der hund", None), (5, "the cat and the dog " * 5000, 0.0)]
    said = lang.identify(spark.createDataFrame(given, "doc_id long, text string, score double"), d).collect()
    assert [r["lang_pred"] for r in said] == ["und", "und", "und", "en", "en", "de", "en"]
    assert [r["rejected"] for r in said[:3]] == [True] * 3 and said[3] == said[4]
    assert lang.identify(spark.createDataFrame([], "doc_id long, text string"), d).count() == 0


def test_copies_do_not_starve_a_language(spark):
    rows = spark.range(0, 60000, 1, 4).selectExpr("id as doc_id", "concat('vier und zwanzig ', id % 7, ' hunde ', repeat(char(97 + id % 7), 9)) as text", "'de' as lang")
    rows = rows.unionByName(spark.range(3000).selectExpr("id as doc_id", "concat('the man and the dog ', id) as text", "'en' as lang"))
    found = lang.learn(rows, sample_docs=20)
    assert set(found) == {"de", "en"}
    assert all(letter * 9 in found["de"].decode() for letter in "abcdefg")
    assert found["en"].count(b"the man") == 20


def test_the_sample_depends_on_rows_alone(spark):
    dice = random.Random(5)
    words = ["".join(dice.choices("abcdefghij", k=5)) for _ in range(300)]
    rows = [(i, " ".join(dice.choices(words, k=dice.randint(3, 3000))), "xy"[i % 2]) for i in range(300)]
    schema = "doc_id long, text string, lang string"
    one = lang.learn(spark.createDataFrame(rows, schema).repartition(2), sample_docs=30)
    dice.shuffle(rows)
    assert one == lang.learn(spark.createDataFrame(rows, schema).repartition(5), sample_docs=30)
    # long texts take part with a stretch from any place
    long = [r for r in rows if len(r[1]) > 6000 and r[2] == "x"]
    held = b"".join(one.values()).decode()
    starts = [t.find(held[k : k + 200].strip()) for k in range(0, len(held), 700) for _, t, _ in long if held[k : k + 200].strip() in t]
    assert any(x > 3000 for x in starts)


def test_nothing_to_learn(spark):
    assert lang.learn(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert lang.identify(docs, {}).first()["lang_pred"] == "und"


def test_narrow_margins_are_rejected():
    languages = lang.Languages({"a": b" xy" * 400, "b": b" xy" * 400})
    name, score, rejected = languages.predict("xy xy xy", 0.002)
    assert (name, score, rejected) == ("a", 0.0, True)


def test_against_brute_force(spark):
    """Every text's bytes with every dictionary, by one-off compressors of the library."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    dictionaries = lang.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [r["text"] for r in docs.collect()] + ["der hund", "el perro y la casa", "x"]
    given = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in lang.identify(given, dictionaries).collect():
        raw = lang.plain(r["text"] or "")
        n = -(-len(raw) // lang.PIECE)
        size = -(-len(raw) // n)
        said = {}
        for name, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=lang.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            said[name] = sum(len(c.compress(raw[k * size : (k + 1) * size] * lang.REPEATS)) for k in range(n))
        first, second = sorted(said.values())[:2]
        if r["lang_pred"] != "und":
            assert said[r["lang_pred"]] == first and abs(r["score"] - (second - first) / second) < 1e-12


def test_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    languages = lang.Languages(lang.learn(docs))
    for words, least in ((4, 0.95), (12, 0.97)):
        cut = [(" ".join(r["text"].split()[5 : 5 + words]), r["lang"]) for r in docs.where(lang.held_out("doc_id")).collect() if r["text"] and r["lang"]]
        cut = [(t, x) for t, x in cut if len(t.split()) == words]
        assert sum(languages.predict(t, 0.0)[0] == x for t, x in cut) >= least * len(cut)
