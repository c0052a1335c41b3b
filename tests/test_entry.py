"""Every query with SQL gives the rows that DuckDB gives for that SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from twinscope.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_is_its_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    cur = duck.execute(own.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    want = rows(cur.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert rows(map(tuple, df.collect()), df.columns) == want


def test_the_privacy_report_is_its_sql_on_many_rows(spark, tmp_path):
    """More rows a side than the sample of 20,000 that nearest rows once took."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (p_partkey + 1000 * i AS p_partkey, CAST(p_size + 60 * (p_partkey % 2) + i % 7 AS INTEGER) AS p_size) FROM '{SF}/part.parquet', range(210) t(i)) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = con.execute(own.ORACLE_SQL["privacy_report_measures"]).fetchall()
    found = [tuple(r) for r in own.privacy_report_measures(spark, str(tmp_path)).collect()]
    assert ("row_distance", "n", 21_000.0) in found
    assert rows(found, ["part", "metric", "value"]) == rows(want, ["part", "metric", "value"])


def test_a_part_that_fails_fails_the_privacy_report(spark, monkeypatch):
    """Left out, its rows would be missing from the result without a word."""

    def broken(pair):
        return pair.real.select(F.raise_error(F.lit("broken")).alias("n"))

    monkeypatch.setattr(own.privacy, "row_distance", broken)
    with pytest.raises(RuntimeError, match="row_distance: (.|\n)*broken"):
        own.privacy_report_measures(spark, SF)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 4


def test_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
