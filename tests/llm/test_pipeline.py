import os

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_stages_decide(spark, tmp_path):
    rows = [
        (1, "the man and the dog in the house and the cat of the town " * 4, "en", "s", 1),
        (2, "the man and the dog in the house and the cat of the town " * 4, "en", "s", 1),
        (3, "der hund und die katze und das haus in der stadt mit dem mann " * 4, "de", "s", 1),
        (4, "12 34 !?", "en", "s", 1),
        (5, None, None, None, None),
        (6, "some other words before one two three four five six seven eight nine ten of them and the town", "en", "s", 1),
        (9, "die katze ist in dem haus und der mann ist in der stadt mit dem hund", "de", "s", 1),
        (10, "the house of the man and the town of the dog with a cat", "en", "s", 1),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(sorted(r["doc_id"] for r in docs.collect()))
        if k < 3:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 4 not in sizes[0] and 5 not in sizes[0] and {1, 2, 3, 6} <= set(sizes[0])
    assert set(sizes[0]) - set(sizes[1]) == {2} and set(sizes[1]) - set(sizes[2]) == {6} and sizes[3] == sizes[2]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sizes[3]


def test_clean_documents_stay(spark):
    out = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and 0.8 * n < out.count() < n
    # the ids are the library's, and decode to the texts
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in out.limit(60).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and len(r["ids"]) == r["n_tokens"]
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
