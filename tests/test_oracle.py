"""Every registered query against its DuckDB oracle on sf0.001 (the driver checks
sf0.01 the same way): same columns, same row multiset."""

import decimal
import math

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
from qtrlens.plans import registry

QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 9)
    return v


_EQUIV = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT",
          "double": "DOUBLE", "boolean": "BOOLEAN"}


def _same_type(spark_t, duck_t):
    if spark_t.startswith("decimal"):
        return duck_t.replace(" ", "").upper() == spark_t.replace(" ", "").upper()
    return _EQUIV.get(spark_t, spark_t).upper() == duck_t.upper()


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


def test_every_query_has_an_oracle():
    assert set(ORACLE) <= set(QUERIES)
    missing = sorted(set(QUERIES) - set(ORACLE))
    assert missing == [], f"queries without oracle SQL: {missing}"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    srecs = [r.asDict() for r in sdf.collect()]
    res = duck.execute(ORACLE[name])
    dcols = [c[0] for c in res.description]
    drecs = [dict(zip(dcols, r)) for r in res.fetchall()]
    assert sorted(sdf.columns) == sorted(dcols)
    dtypes = {c[0]: str(c[1]) for c in res.description}
    for c, t in sdf.dtypes:
        assert _same_type(t, dtypes[c]), (c, t, dtypes[c])
    cols = sorted(dcols)
    assert _rows(srecs, cols) == _rows(drecs, cols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["year", "quarter", "transaction_type", "total_amount", "total_count", "prev_amount",
                          "qoq_growth_pct"]
