import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Rows of a DuckDB query over a folder of fixtures, as the differential test compares them."""
    import duckdb

    def run(sql, sf_dir):
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            path = f"{sf_dir}/{f}/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else f"{sf_dir}/{f}"
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
        return con.execute(sql).fetchdf()

    return run


@pytest.fixture(scope="session")
def rows_of():
    """A frame's rows as sorted tuples: columns by name, whole numbers as one kind, floats to 6 places, nulls alike."""
    import numpy as np
    import pandas as pd

    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if isinstance(x, (int, float, np.integer, np.floating)):
            return round(float(x), 6)
        return str(x)

    def run(df):
        df = df[sorted(df.columns)]
        return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)

    return run
