"""Driver contract and the DuckDB oracle on the smallest test tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL_DIR
from usagelens.plans.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def test_entry_flagship(spark):
    df = E.entry(spark)
    assert len(df.columns) == 49 and df.columns[-1] == "approx_query_cost"
    assert df.count() > 0


def test_every_query_of_the_library_has_an_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL_DIR}/{t}.parquet')")
    yield con
    con.close()


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
        return v

    return sorted(tuple(repr(norm(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SMALL_DIR)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _canon(sdf.columns, [tuple(r) for r in sdf.collect()]) == _canon(dcols, res.fetchall())
