import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").appName("graphloom-tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    session = builder.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{DATA}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*'}'")
    return con


def canonical(df):
    """Rows of a pandas frame as sorted text, columns by name."""
    import numpy as np
    import pandas as pd

    def text(x):
        if isinstance(x, (list, tuple, np.ndarray)):
            return "[" + ",".join(map(text, x)) + "]"
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
            return "~"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, np.integer, float, np.floating)):
            return repr(round(float(x), 6) + 0.0)
        return str(x)

    return sorted(tuple(text(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))
