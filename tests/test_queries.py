import math
import os

import duckdb
import pytest

from rostrum.plans import catalogue, fixtures

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in fixtures.TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def rows(frame, cols):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, D).toPandas()
    if name in catalogue.oracle_sql():
        want = duck.sql(catalogue.oracle_sql()[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert rows(got, cols) == rows(want, cols)
    else:
        assert len(got)
