"""Every registered query of the package against its SQL twin in DuckDB, and the shape of the others."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from trailmill import queries as own

SF_DIR = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF_DIR.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def rows(columns: list[str], values) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(list(x)) if isinstance(x, (list, tuple)) else str(x)

    return sorted(str([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = own.queries()[name](spark, str(SF_DIR))
    want = duck.sql(own.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(own.queries()) - set(own.oracle_sql())))
def test_has_rows(spark, name):
    df = own.queries()[name](spark, str(SF_DIR))
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0
