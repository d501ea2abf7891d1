"""Each query of the registry against its SQL in another engine, over whole tables."""

import duckdb
import pytest

from varilume.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(map(rounded, r)) for r in df.select(*columns).collect()), key=repr)
    got = duck.execute(ORACLES[name])
    at = [[d[0] for d in got.description].index(c) for c in columns]
    theirs = sorted((tuple(rounded(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
