import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from cinderplan.ship import ship

    ship(s)
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def rows(frame):
    """Rows as comparable tuples, columns by name."""
    names = sorted(frame.columns)
    plain = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "__float__") and not isinstance(v, str) else str(v)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=str)
