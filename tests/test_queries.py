"""Every query of the timeline operators against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from cuespan.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    df = df[sorted(df.columns)]

    def text(v):
        if pd.isna(v):
            return ""
        return str(v) if isinstance(v, (bool, str)) or not hasattr(v, "real") else f"{v:.9g}"

    return sorted(tuple(map(text, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
