"""Queries against an independent engine on the driver's smallest tables."""

from pathlib import Path

import pytest

from veltrial.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are absent")


@pytest.mark.parametrize("name", ["op4_vectors", "op11_phrases", "op12_stream_dedup"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, str(DATA)).toPandas()[list(want.columns)]
    key = list(want.columns)
    as_rows = lambda f: sorted(tuple(str(v) for v in r) for r in f[key].astype(object).itertuples(index=False))
    assert len(got) == len(want) > 0 and as_rows(got) == as_rows(want)
