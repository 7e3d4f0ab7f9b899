"""Every registered query against its DuckDB oracle at sf0.001 (the driver
runs the same comparison at sf0.01)."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from charlens.sources.fixtures import BASE_TABLES

SF = "/root/testdata/sf0.001"

# Spark result type -> DuckDB result type
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "float": "FLOAT"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "__float__") and not isinstance(v, int):
        return round(float(v), 6)
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha1("\n".join(keyed).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    ocols = list(rel.columns)
    otypes = dict(zip(ocols, [str(t) for t in rel.types]))
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    for c, t in df.dtypes:
        assert _TYPES.get(t, t) == otypes[c], (c, t, otypes[c])
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_every_query_runs(spark):
    for name, fn in E.queries().items():
        if name not in E.oracle_sql():
            assert fn(spark, SF).count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
