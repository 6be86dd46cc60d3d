"""Every query with SQL against an independent engine on the driver's small tables."""

import math
from pathlib import Path

import pytest

from veltrial.plans.oracles import ORACLES
from veltrial.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("events", "orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def canonical(frame):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "NaT":
            return "null"
        return f"{x:.8g}" if isinstance(x, float) else str(x).removesuffix(" 00:00:00")

    cols = sorted(frame.columns)
    return cols, sorted(tuple(cell(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert canonical(QUERIES[name](spark, str(DATA)).toPandas()) == canonical(duck.sql(ORACLES[name]).df())
