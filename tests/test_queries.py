"""Every query against its SQL, over the smallest tables."""

import decimal
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

from colloquy.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6) + 0.0
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(v[i]) for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", ["meeting_detector", "buffer_flush", "textrank_topk", "transcript_clean", "meeting_summary", "kmeans_diarize"])
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training_data_operators(tmp_path):
    """Both folders deleted, with or without the pipeline's file: the entry imports and has all the other queries."""
    root = pathlib.Path(__file__).parents[1]
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse")
    shutil.copytree(root, tmp_path / "copy", ignore=gone)
    said = "import __spark_entry__ as e; q = set(e.queries()); assert not any(x.startswith('op') or x == 'pipeline' for x in q); print(len(q), len(e.oracle_sql()))"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", said], cwd=tmp_path / "copy", capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
