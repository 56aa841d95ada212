import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import seqframe.queries as base

SF = "/root/testdata/sf0.001"
TABLES = "nation customer supplier part orders lineitem documents benchmark"


def plain(x):
    if not isinstance(x, str) and pd.isna(x):
        return None
    if isinstance(x, float) and x == int(x):
        return int(x)
    return x.item() if hasattr(x, "item") else x


@pytest.mark.parametrize("name", sorted(base.oracle_sql()))
def test_oracle(spark, name):
    """Every query with SQL against DuckDB."""
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, sql = base.queries()[name](spark, SF).toPandas(), con.sql(base.oracle_sql()[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(sql.columns)
    rows = lambda df: sorted(repr([plain(x) for x in r]) for r in df[cols].astype(object).to_numpy().tolist())
    assert rows(mine) == rows(sql)


def test_entry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["search_hamming", "hit_best", "hit_count"])
def test_whole_names(spark, name):
    """Every row of part asks with its whole name."""
    asked = {r.query_id for r in base.queries()[name](spark, SF).select("query_id").collect()}
    assert asked == {r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
