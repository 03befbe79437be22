"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessellis.plans import analysis_catalog, catalog, discourse_catalog, page_catalog, text_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(rows: pd.DataFrame) -> list[str]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        return round(float(v), 8) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).removesuffix(" 00:00:00")

    rows = rows[sorted(rows.columns)]
    return sorted(str([cell(v) for v in row]) for row in rows.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    mine, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine) == plain(theirs)


@pytest.mark.parametrize("name", sorted(catalog.GOLDEN))
def test_golden_rows_match_sql(spark, duck, name):
    mine, theirs = catalog.GOLDEN[name](spark, SF).toPandas(), duck.execute(catalog.GOLDEN_SQL[name]).df()
    assert plain(mine) == plain(theirs)


def test_queries_without_sql_have_tests_of_their_own():
    golden = {"numeric_mentions", "topic_classifier"}  # test_golden.py: golden rows, brute force, held-out labels
    whole = {"extract_facts", "numeric_coverage"}  # test_whole_tables.py: facts put among the documents
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == golden | whole
