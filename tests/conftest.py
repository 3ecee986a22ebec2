from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def walk() -> pd.DataFrame:
    """Two seeded hourly walks of 300 bars with volume."""
    rng, parts = np.random.default_rng(0), []
    for symbol in ("AAA", "BBB"):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
        parts.append(pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2024-01-01", periods=300, freq="h"), "close": close, "high": close * 1.004, "low": close * 0.996, "volume": rng.integers(1, 1000, 300).astype(float)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, walk):
    return spark.createDataFrame(walk, "symbol string, ts timestamp_ntz, close double, high double, low double, volume double")
