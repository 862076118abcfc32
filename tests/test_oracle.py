"""Every registered query against its DuckDB oracle on sf0.001 (the driver's gate runs the same at sf0.01)."""

import math
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

ORACLE = entry.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = duck.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, res.fetchall())


def test_every_query_without_oracle_has_rows(spark):
    # queries without an oracle still have to run on the whole tables
    for name, fn in entry.queries().items():
        if name in ORACLE:
            continue
        assert fn(spark, SF_SMALL).count() > 0, name


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["merchant_id", "year", "month", "total_sales", "total_tax", "total_discount", "profit_estimate"]
