"""Every query of the catalogue against DuckDB on the smallest tables, or its own properties."""

import duckdb
import pytest

from linefold.plans import catalogue, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROWS_ONLY = {"seq_diff_opcodes", "c_statement_units", "c_backward_slice", "lr_cv_detection", "lr_cv_uncapped", "fusion_cv", "detection_study", "version_deltas"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def same(x):
    return f"{x:.5g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in ROWS_ONLY:
        assert name not in oracle.SQL and rows
        return
    r = con.execute(oracle.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([tuple(same(x[names.index(c)]) for c in sorted(names)) for x in r.fetchall()])
    assert sorted([tuple(same(x[c]) for c in sorted(names)) for x in rows]) == want


def test_every_oracle_has_a_query():
    assert set(oracle.SQL) == set(catalogue.QUERIES) - ROWS_ONLY


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(oracle.SQL) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
