import duckdb
import pytest

from strata.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_nearest_far_against_sql_with_its_own_tables(spark):
    con = duckdb.connect()
    for t in ("supplier", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLES["q_nearest_far"])
    names = [c[0] for c in want.description]
    expected = sorted(want.fetchall())
    rows = sorted(tuple(r) for r in QUERIES["q_nearest_far"](spark, DATA).select(*names).collect())
    assert len(rows) == len(expected) > 0
    for a, b in zip(rows, expected):
        assert a == pytest.approx(b, abs=1e-5)
