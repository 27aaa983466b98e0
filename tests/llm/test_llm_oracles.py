"""The training-data queries that SQL can express give the same rows in DuckDB."""

import duckdb
import pytest

from tasklattice.llm import registry


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_one_query_for_each_operator_runs_over_its_whole_table(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    key = "page_id" if "page_id" in df.columns else "doc_id"
    table = "pages" if key == "page_id" else "documents"
    assert df.select(key).distinct().count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
