"""Every query with an oracle gives the same columns, rows and values as DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.harness import compare

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, sf_dir, name):
    problem, _, _ = compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name])
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    assert all(len(r) == len(df.columns) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "rank" in df.columns


@pytest.mark.parametrize("parts", [1, 2, 7])
@pytest.mark.parametrize("name", ["cnd2_cluster_candidates", "spl2_stratified_split", "cat6_chunk_cadences", "eval1_roc_auc"])
def test_partition_count_does_not_matter(spark, duck, sf_dir, name, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        problem, _, _ = compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert problem is None
