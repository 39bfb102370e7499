"""Every registered price query that SQL can express gives what DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tradewind.plans import registry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(pd.Timestamp(x)) if hasattr(x, "year") else str(int(x)) if hasattr(x, "item") and not isinstance(x, bool) and float(x).is_integer() else str(x)

    return sorted(tuple(plain(x) for x in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    left, right = _rows(got), _rows(want)
    assert len(left) == len(right)
    assert [x for x in zip(left, right, strict=True) if x[0] != x[1]][:3] == []
    if name not in ("price_history_offer",):
        assert left
