"""Every query of the library against its SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from ledgerloom.jobs.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(df: pd.DataFrame) -> Counter:
    cols = sorted(df.columns)
    clean = df[cols].map(lambda v: None if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v))
    return Counter(map(tuple, clean.where(clean.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
