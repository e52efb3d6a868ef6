import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def walk(ticker: str, n: int, seed: int, gap: float = 0.3) -> pd.DataFrame:
    """A random-walk series with holes in the calendar."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    spread = close * rng.uniform(0.001, 0.03, n)
    days = np.cumsum(1 + (rng.random(n) < gap))
    return pd.DataFrame({
        "ticker": ticker, "date": [dt.date(1990, 1, 1) + dt.timedelta(days=int(d)) for d in days],
        "open": close - spread / 2, "high": close + spread, "low": close - spread, "close": close,
        "volume": rng.integers(100, 10000, n)})


def flat(ticker: str, n: int) -> pd.DataFrame:
    return pd.DataFrame({
        "ticker": ticker, "date": [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(n)],
        "open": 5.0, "high": 5.0, "low": 5.0, "close": 5.0, "volume": 0}).astype({"volume": "int64"})


@pytest.fixture(scope="session")
def panel_pd():
    return pd.concat([walk("HOT", 3000, 1), walk("MID", 1500, 2), walk("T60", 60, 3), walk("T49", 49, 4),
                      walk("ONE", 1, 5), flat("FLAT", 80)], ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, panel_pd):
    return spark.createDataFrame(panel_pd).repartition(3).cache()


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks far smaller than a ticker, so that every operator crosses block edges."""
    from tapewise.operators import panel
    monkeypatch.setattr(panel, "BLOCK_ROWS", 128)
