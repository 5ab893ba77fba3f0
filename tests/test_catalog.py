"""Every registered query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from skein import catalog

SLOW = {"callers_one_hop", "bigram_density", "bigram_regex_candidates"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_query_equals_sql(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert got == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "line", "text"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).limit(5).count() >= 0


def test_filters_reach_the_scan(spark, sf):
    plan = catalog.QUERIES["grep_literal_all"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    generate, scan = plan.index("Generate"), plan.index("FileScan")
    assert "RLIKE" in plan[generate:scan] and "ReadSchema: struct<doc_id" in plan
