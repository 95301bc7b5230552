import duckdb
import pytest

import strata.more_queries  # noqa: F401
from strata.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    expected = sorted([tuple(r[k] for k in order) for r in want.fetchall()], key=str)
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    rows = sorted([tuple(r) for r in got.select(*sorted(got.columns)).collect()], key=str)
    assert len(rows) == len(expected)
    for a, b in zip(rows, expected):
        assert a == pytest.approx(b, abs=1e-5)
