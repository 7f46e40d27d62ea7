"""Every query of the reference's own operators against its SQL, on the smallest tables."""

import math
import warnings
from pathlib import Path

import duckdb
import pytest
from fringeworks.plans import registry

SF = "/root/testdata/sf0.001"


def rows(df):
    """Rows as tuples, ordered by what is no float first."""
    df = df[sorted(df.columns)]

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        return v if isinstance(v, (int, bool, str, type(None))) else str(v)

    out = [tuple(map(cell, r)) for r in df.itertuples(index=False)]
    return sorted(out, key=lambda r: ([repr(x) for x in r if not isinstance(x, float)], [x for x in r if isinstance(x, float)]))


def same(x, y):
    """Equal, but for the last of the six digits of rounded numbers: engines round ties differently."""
    return abs(x - y) <= 1.5e-6 * max(1, abs(x)) if isinstance(x, float) and isinstance(y, (int, float)) else x == y


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, tables, name):
    mine, want = registry.QUERIES[name](spark, SF).toPandas(), tables.execute(registry.SQL[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    a, b = rows(mine), rows(want)
    assert len(a) == len(b)
    assert not [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))][:3]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, name):
    """A solver that ends before it has converged warns, and fails here."""
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        assert registry.QUERIES[name](spark, SF).count() > 0
