"""Every registered query against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def near(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(near(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, rows) == canonical(columns, cursor.fetchall())


def test_no_nan_leaves_a_query(spark):
    for name in ("finite_and_clipped", "scaled_rows", "full_metrics", "curated_rows"):
        df = QUERIES[name](spark, SF_DIR)
        doubles = [c for c, t in df.dtypes if t == "double"]
        assert df.where(" OR ".join(f"isnan({c})" for c in doubles)).isEmpty(), name


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() == 4


@pytest.mark.parametrize("name", ["pair_ranks", "pair_round_robin", "robust_fit", "group_split_greedy", "batch_losses"])
def test_partition_count_does_not_matter(spark, name):
    results = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = QUERIES[name](spark, SF_DIR)
        results.append(canonical(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
