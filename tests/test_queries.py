"""Every query that has SQL gives the same rows in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from axonflow.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: str(v) if isinstance(v, list) else None if isinstance(v, float) and math.isnan(v) else v
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    got = df.collect()
    if name not in SQL:
        assert df.columns and got
        return
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cursor.fetchall())
    have = rows(df.columns, got)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and isinstance(y, float):
                assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-8)
            else:
                assert x == y
