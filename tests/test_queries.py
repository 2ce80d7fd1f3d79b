"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallygrid.plans import queries
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, small, duck, name):
    got, want = same_rows(entry.queries()[name](spark, small), duck, queries.SQL[name])
    assert got == want


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"normal", "instances", "fscore", "band", "hardcode"}


def test_rows_only_queries_run(spark, small):
    for name in set(queries.QUERIES) - set(queries.SQL):
        entry.queries()[name](spark, small).count()


def _beside_sql(spark, tmp_path, name, table, rows):
    """The rows of a query over a table of its own, and those of its SQL."""
    rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    return same_rows(entry.queries()[name](spark, str(tmp_path)), con, queries.SQL[name])


def test_amounts_in_millions_of_any_size_and_none(spark, tmp_path):
    keys = [None, 0, 1, 5, 7, 1999, 49_999, 50_000, 50_001, 60_001, 149_999, 899_999, 900_000, 8_999_999, 123_456_789, -1, -5, -60_001]
    got, want = _beside_sql(spark, tmp_path, "percent_and_money", "orders", spark.createDataFrame([(k,) for k in keys], "o_orderkey long"))
    assert got == want and len(got) == len(keys)


def test_balances_that_look_like_years_are_not_among_the_years(spark, tmp_path):
    spark.range(1, 6).select((F.col("id") - 1).cast("int").alias("r_regionkey")).coalesce(1).write.parquet(f"{tmp_path}/region.parquet")
    balances = [(k, {0: 2050.0, 1: 1990.0, 2: 2100.0}.get(k % 3, 1.5) if k % 4 else 17.25) for k in range(130)]
    got, want = _beside_sql(spark, tmp_path, "header_years", "supplier", spark.createDataFrame(balances, "s_suppkey long, s_acctbal double"))
    assert got == want and len(got) == 111
