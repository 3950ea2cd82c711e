"""The registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.tables import TABLES
from workloads.oracles import ORACLES
from workloads.queries import QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ("url_parts", "page_links", "clean_text", "headings", "to_markdown", "discover_pages",
         "index_full", "context_short", "crawl_docs", "sitemap_pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in data)


def test_every_query_has_its_twin():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    cursor = duck.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
