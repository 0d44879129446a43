"""Queries that have SQL, against DuckDB on the smallest tables, and those that have none against brute force."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmend.operators import evaluate as E
from textmend.plans import file_queries, queries, score_queries  # noqa: F401

TABLES = "/root/testdata/sf0.001"
#: A few of each kind; the rest is compared outside of the tests.
NAMES = [
    "text_folder", "pair_scan", "file_digests", "metadata_scan", "canonical_lines", "frozen_pool", "freeze_checks", "method_configs", "store_resume", "row_counts", "fill_rows", "seq2seq_answers", "answer_faults", "repair_scores",
    "damage_records", "slot_views", "fact_slots", "piece_ceiling", "probe_sample", "chosen_docs", "per_word_error", "paired_tests", "interval_cells", "parsed_cells", "value_vectors", "near_words", "chat_client", "retry_rules",
]


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return None if math.isnan(float(v)) else float(f"{float(v):.9g}")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_bootstrap(spark):
    """Against one resample at a time, with the same stream of draws."""
    rng = np.random.default_rng(1)
    rows = [("m", "l", "x", f"{i:03d}", float(rng.integers(0, 5)), 1.0 + float(rng.integers(0, 3))) for i in range(37)]
    df = spark.createDataFrame(rows, "method string, level string, metric string, id string, num double, den double")
    got = E.bootstrap(df.repartition(3), 10_000, 42).first()
    num, den = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    draws = np.random.default_rng(42).integers(0, 37, size=(10_000, 37))
    stats = [num[d].sum() / den[d].sum() for d in draws]
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(stats, [0.025, 0.975]))) and got.value == pytest.approx(num.sum() / den.sum())


def test_value_vectors_refuse_gaps(spark):
    rows = spark.createDataFrame([("m", "l", "x", "a", 1.0, 1.0)], "method string, level string, metric string, id string, num double, den double")
    with pytest.raises(Exception, match="incomplete"):
        E.value_vectors(rows, spark.createDataFrame([("a",), ("b",)], "id string")).collect()
    assert E.value_vectors(rows, rows.select("id")).first().num == [1.0]


def test_spread(spark, tmp_path):
    from textmend.sources.corpus import spread

    spark.range(100).withColumn("k", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    assert one.rdd.getNumPartitions() == 1 and spread(one, "id", "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(one, "id").count() == 100


def test_entry_needs_no_session_to_be_imported():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
