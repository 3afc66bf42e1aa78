import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def make_bars(spark):
    """Closes (and opens) on business days from a date -> a frame of bars."""
    import pandas as pd

    def make(closes, opens=None, start="2024-01-01", symbol="X"):
        days = pd.bdate_range(start, periods=len(closes))
        opens = closes if opens is None else opens
        rows = [(symbol, d.date(), float(o), float(max(o, c)), float(min(o, c)), float(c), float(c), 1.0, "test") for d, o, c in zip(days, opens, closes)]
        return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, adj_close double, volume double, source string")

    return make
