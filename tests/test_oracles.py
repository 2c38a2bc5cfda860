"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from provloom.plans import casework as plans

DATA = "/root/testdata/sf0.001"


def rows(frame):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 5) if isinstance(x, (float, int)) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "documents", "labels", "benchmark", "part", "supplier"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, duck, name):
    import pandas as pd

    want = duck.sql(plans.oracle_sql()[name])
    got = plans.queries()[name](spark, DATA)
    got = pd.DataFrame([tuple(r) for r in got.collect()], columns=got.columns)
    assert rows(got) == rows(pd.DataFrame(want.fetchall(), columns=want.columns))
