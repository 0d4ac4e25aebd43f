"""Bars and running means over a stream of ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import span


def windowed(ticks: DataFrame, unit: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of ``unit`` from a stream of (symbol, ts, value); ticks later than ``late`` are dropped.

    Ticks of one symbol at the same instant are ordered by value.
    """
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at = F.struct("ts", "value")
    made = timed.groupBy("symbol", F.window("ts", unit).alias("w")).agg(
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    return made.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "volume")


def running_ema(bars: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, bar_ts, ema) over a stream of bars, which must arrive in order within each symbol.

    State is one number for each symbol.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    alpha = span(n)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values("bar_ts", ignore_index=True)
            made = []
            for x in frame["close"]:
                last = x if last is None else (1 - alpha) * last + alpha * x
                made.append(last)
            yield pd.DataFrame({"symbol": frame["symbol"], "bar_ts": frame["bar_ts"], "ema": made})
        state.update((last,))

    return bars.groupBy("symbol").applyInPandasWithState(run, "symbol string, bar_ts timestamp_ntz, ema double", "last double", "append", GroupStateTimeout.NoTimeout)
