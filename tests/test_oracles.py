"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from finrecon.plans import fixtures, registry

SQL = registry.oracle_sql()
KINDS = {("bigint", "BIGINT"), ("int", "INTEGER"), ("string", "VARCHAR"), ("double", "DOUBLE"), ("boolean", "BOOLEAN"), ("date", "DATE")}


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 7) + 0.0
    return float(v) if isinstance(v, Decimal) else v


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for t in fixtures.TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, small, duck):
    ours = registry.queries()[name](spark, small)
    result = duck.execute(SQL[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    columns = sorted(ours.columns)
    assert columns == sorted(kinds)
    assert {(t, kinds[c]) for c, t in ours.dtypes} <= KINDS
    at = [list(kinds).index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in ours.collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(name, spark, small):
    assert registry.queries()[name](spark, small).count() > 0
