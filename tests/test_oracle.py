"""Every query with SQL gives the rows that DuckDB gives for it."""

import math
from pathlib import Path

import duckdb
import pytest

from brindle.plans.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")


def rows(table, names):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 3) + 0.0
        if hasattr(v, "as_tuple"):
            return round(float(v), 3)
        return v

    return sorted((tuple(plain(r[n]) for n in names) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, str(DATA))
    names = sorted(got.columns)
    found = [r.asDict() for r in got.collect()]
    assert found
    if name not in ORACLE:
        return
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    want = c.sql(ORACLE[name])
    assert sorted(want.columns) == names
    expected = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    a, b = rows(found, names), rows(expected, names)
    assert len(a) == len(b)
    # numbers of either engine's types compare as floats
    num = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    bad = [(x, y) for x, y in zip(sorted((tuple(map(num, r)) for r in a), key=repr), sorted((tuple(map(num, r)) for r in b), key=repr), strict=True) if any((isinstance(p, float) and isinstance(q, float) and abs(p - q) > 2e-3) or (not (isinstance(p, float) and isinstance(q, float)) and p != q) for p, q in zip(x, y, strict=True))]
    assert not bad, bad[:3]
