"""Running values over blocks against pandas, with blocks of a few rows and one symbol that holds most of them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import scan
from barloom.functions.windows import with_ema


def frame(seed=3, n=1500):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"symbol": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n)), "bar_ts": pd.to_datetime(rng.permutation(n) * 3600, unit="s"), "x": rng.normal(100, 20, n)})
    df["y"] = np.where(rng.random(n) < 0.3, np.nan, df["x"] - 100)
    df["block"] = "clash"
    return df.sort_values(["symbol", "bar_ts"], ignore_index=True)


def given(spark, df):
    made = spark.createDataFrame(df.sample(frac=1, random_state=1)).withColumn("y", F.nanvl("y", F.lit(None)))
    return made.withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz")).repartition(5)


def back(made):
    return made.toPandas().sort_values(["symbol", "bar_ts"], ignore_index=True)


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_running_values(spark, monkeypatch, size):
    monkeypatch.setattr(scan, "SIZE", size)
    df = frame()
    R = scan.Running
    made = scan.running(
        scan.placed(given(spark, df), "symbol"), ("symbol",),
        total=R("sum", "y"), n=R("count", "y"), top=R("max", "y"), low=R("min", F.col("x") * 2), last=R("last", "y"), earlier=R("last", "y", now=False), prev=R("before", "y"), done=R("sum", "x", now=False),
    )
    assert scan.AT in made.columns and made.columns[:4] == ["symbol", "bar_ts", "x", "y"]
    got, by = back(made), df.groupby("symbol")
    assert len(got) == len(df)
    filled = df.assign(y0=df.y.fillna(0.0)).groupby("symbol")
    known = by.y.cumcount() >= 0
    some = by.y.transform(lambda s: s.notna().cumsum())
    expect = {
        "total": filled.y0.cumsum().where(some > 0), "n": some.astype(float), "top": by.y.transform(lambda s: s.cummax().ffill()), "low": by.x.cummin() * 2,
        "last": by.y.ffill(), "earlier": by.y.transform(lambda s: s.ffill().shift()), "prev": by.y.shift(), "done": by.x.transform(lambda s: s.cumsum().shift()),
    }
    assert known.all()
    for name, values in expect.items():
        np.testing.assert_allclose(got[name].astype(float), values, rtol=1e-9, atol=1e-9, err_msg=name)


@pytest.mark.parametrize("size,stretch", [(1, 3), (5, 2), (4096, 256)])
def test_exponential_means(spark, monkeypatch, size, stretch):
    monkeypatch.setattr(scan, "SIZE", size)
    monkeypatch.setattr(scan, "STRETCH", stretch)
    df = frame(4)
    df.loc[df.groupby("symbol").cumcount() < 9, "y"] = np.nan  # a history that begins late
    steps = [("e1", "x", 2 / 21), ("e2", F.col("y"), 1 / 3), ("e3", "x", 1.0), ("e4", "x", 0.97)]
    got = back(with_ema(given(spark, df), *steps))
    assert scan.AT not in got.columns
    for name, source, alpha in steps:
        x = df["y" if name == "e2" else source]
        want = x.groupby(df.symbol).transform(lambda s, a=alpha: s.dropna().ewm(alpha=a, adjust=False).mean().reindex(s.index).ffill())
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9, atol=1e-9, err_msg=name)
    got = back(with_ema(given(spark, df), ("e", "x", 0.1), ("f", "y", 0.5), adjust=True))
    for name, source, alpha in (("e", "x", 0.1), ("f", "y", 0.5)):
        want = df[source].groupby(df.symbol).transform(lambda s, a=alpha: s.dropna().ewm(alpha=a, adjust=True).mean().reindex(s.index).ffill())
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9, atol=1e-9, err_msg=name)


def test_no_task_sees_a_whole_history(spark, monkeypatch):
    """No Python, and every window over rows is by block."""
    monkeypatch.setattr(scan, "SIZE", 50)
    made = with_ema(scan.placed(given(spark, frame()), "symbol"), ("e", "x", 0.1))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert all("__block" in line for line in plan.splitlines() if "Window [" in line)
    held = scan.placed(given(spark, frame()), "symbol")
    tasks = held.where("symbol = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_empty(spark):
    none = spark.createDataFrame([], "symbol string, bar_ts timestamp_ntz, close double")
    assert with_ema(none, ("e", "close", 0.1)).count() == 0
    assert scan.running(scan.placed(none, "symbol"), ("symbol",), s=scan.Running("sum", "close")).count() == 0
