import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from memlattice.session import get_session

    s = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


def shown(v):
    """A value as text; lists whole, numbers to six significant digits, null and NaN empty."""
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
        return str([shown(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def content(df):
    df = df[sorted(df.columns)]
    return sorted(df.columns), sorted(tuple(shown(v) for v in row) for row in df.values.tolist())


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.fixture(scope="session")
def agrees(spark, duck):
    """Runs a query on the smallest tables and compares it with its SQL, if it has one."""

    def check(query, sql):
        found = query(spark, SMALL).toPandas()
        if sql is not None:
            assert content(found) == content(duck.sql(sql).df())

    return check
