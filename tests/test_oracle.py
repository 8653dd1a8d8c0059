"""Every registered query against its DuckDB oracle on the smallest test data (the driver uses sf0.01)."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = os.environ.get("LEDGERLENS_ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_canon(r[i]) for i in order) for r in records), key=lambda t: tuple("" if x is None else x for x in t))


def test_source_columns_are_those_of_the_tables(con):
    from ledgerlens.catalog.oracle import ORACLE, described

    types = described(ORACLE)
    for name, sql in ORACLE.items():
        rel = con.sql(sql)
        assert [(c, str(t)) for c, t in zip(rel.columns, rel.types)] == types[name], name


def test_every_query_has_an_oracle():
    missing = set(E.REGISTRY) - set(E.oracle_sql())
    assert not missing


SPARK_TO_DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) & set(E.REGISTRY)))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    ocols = rel.columns
    assert sorted(df.columns) == sorted(ocols)
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert spark_types == {c: str(t) for c, t in zip(ocols, rel.types)}
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 5
