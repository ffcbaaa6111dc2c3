"""Every core query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from quartzmill import queries as Q


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


def bag(rows, columns, order):
    pick = [columns.index(c) for c in order]
    return sorted((tuple(cell(row[i]) for i in pick) for row in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = Q.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in Q.SQL:
        want = duck.execute(Q.SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        assert bag(got, df.columns, order) == bag(want.fetchall(), names, order)
