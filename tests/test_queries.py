"""Every registered query of the package against its DuckDB counterpart, as multisets of rows."""

import math

import duckdb
import pytest

from siltstone import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries without SQL; test_brute.py and test_streams.py compare them with plain Python or another form.
BRUTE = {"budget_reserve_fold", "budget_reserve_stream", "canonicalise_developers", "document_dates", "fuzzy_name_join", "layered_dedup", "layered_dedup_sweep", "project_search", "url_canonical"}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


def rows(table, columns):
    return sorted(zip(*[[plain(v) for v in table.column(c).to_pylist()] for c in columns]))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    table = got.select(*columns).toArrow()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert name in BRUTE
        return
    want = duck.execute(sql).to_arrow_table()
    assert sorted(want.column_names) == columns
    assert rows(table, columns) == rows(want, columns)


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
