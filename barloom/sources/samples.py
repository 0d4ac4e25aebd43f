"""Seeded sample bars and lists of symbols, for trying things out without a data feed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scan import Running, placed, running

# Symbols by market; an unknown market counts as the first.
SYMBOLS = {
    "A股": ("000001", "600036", "601318", "601166", "002142"),
    "美股": ("AAPL", "GOOGL", "MSFT", "AMZN", "TSLA"),
}
# Mean and deviation of a day's return.
DRIFT, VOLATILITY = 0.0003, 0.018
#: A day opens at most so far from the close before, and its high and low lie at most so far beyond open and close.
GAP, REACH = 0.004, 0.01
FIRST, VOLUME = (10.0, 200.0), (500_000, 1_500_000)


def symbols_of(market: str, limit: int | None = None) -> tuple[str, ...]:
    return SYMBOLS.get(market, next(iter(SYMBOLS.values())))[:limit]


def _draw(what: str) -> Column:
    """A number from 0 to 1 for each seed and day, the same at every run."""
    return (F.pmod(F.xxhash64("seed", "day", F.lit(what)), F.lit(1 << 32)) + 0.5) / float(1 << 32)


def sample_bars(spark: SparkSession, symbols: list[str], days: int = 120, end: str = "2024-06-28", seed: str | None = None) -> DataFrame:
    """``days`` business days of bars up to ``end`` for each symbol: a random walk of hashed draws.

    A symbol's walk follows from its name alone, so any number of them is made side by
    side; with ``seed`` all symbols have the same walk.
    """
    last = F.lit(end).cast("date")
    dates = F.filter(F.sequence(F.date_sub(last, 2 * days + 7), last), lambda d: F.weekday(d) < 5)
    named = spark.createDataFrame([(s,) for s in symbols], "symbol string").withColumn("seed", F.lit(seed) if seed is not None else F.col("symbol"))
    each = named.select("symbol", "seed", F.posexplode(F.slice(dates, -days, days)).alias("day", "date")).withColumn("bar_ts", F.col("date").cast("timestamp_ntz"))
    normal = F.sqrt(-2.0 * F.ln(_draw("size"))) * F.cos(2.0 * math.pi * _draw("angle"))
    start = F.lit(FIRST[0]) + (F.pmod(F.xxhash64("seed"), F.lit(10_000)) / 10_000.0) * (FIRST[1] - FIRST[0])
    walked = running(placed(each.withColumn("step", F.ln(1.0 + DRIFT + VOLATILITY * normal)), "symbol"), ("symbol",), grown=Running("sum", "step"), before=Running("sum", "step", now=False))
    close, prev = start * F.exp("grown"), start * F.exp(F.coalesce("before", F.lit(0.0)))
    made = walked.withColumn("c", close).withColumn("o", prev * (1.0 + GAP * (2.0 * _draw("gap") - 1.0)))
    high, low = F.greatest("o", "c") * (1.0 + REACH * _draw("high")), F.least("o", "c") * (1.0 - REACH * _draw("low"))
    volume = F.floor(VOLUME[0] + _draw("volume") * (VOLUME[1] - VOLUME[0])).cast("double")
    two = {"open": F.col("o"), "high": high, "low": low, "close": F.col("c")}
    return made.select("symbol", "bar_ts", *[F.round(v, 2).alias(k) for k, v in two.items()], volume.alias("volume"))
