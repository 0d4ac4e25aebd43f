"""Price bars for all symbols in one DataFrame: symbol, bar_ts, open, high, low, close, volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

COLUMNS = ("symbol", "bar_ts", "open", "high", "low", "close", "volume")
#: Column names of data providers.
RENAMES = {
    "日期": "bar_ts", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount",
    "trade_date": "bar_ts", "vol": "volume", "date": "bar_ts", "datetime": "bar_ts", "time": "bar_ts", "timestamp": "bar_ts",
}


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.struct("ts", "event_id")
    return resample(events.select(F.col("event_type").alias("symbol"), "ts", at.alias("at"), "value"), "hour")


def hourly_by_group(spark: SparkSession, sf_dir: str, groups: int = 8) -> DataFrame:
    """Hourly bars of each event type within groups of users: more symbols, as a screen has."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    symbol = F.concat(F.col("event_type"), F.lit("-"), F.pmod("user_id", F.lit(groups)).cast("string"))
    return resample(events.select(symbol.alias("symbol"), "ts", F.struct("ts", "event_id").alias("at"), "value"), "hour")


def smoothed(bars: DataFrame, n: int = 24) -> DataFrame:
    """Bars whose prices are means of their last ``n``, for strategies that follow a trend."""
    over = W.partitionBy("symbol").orderBy("bar_ts").rowsBetween(-(n - 1), 0)
    return bars.withColumns({c: F.avg(c).over(over) for c in ("open", "high", "low", "close")})


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each user's events: many symbols with short histories."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.struct("ts", "event_id")
    return resample(events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("symbol"), "ts", at.alias("at"), "value"), "day")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each order priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.struct("o_orderdate", "o_orderkey")
    return resample(orders.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), at.alias("at"), F.col("o_totalprice").alias("value")), "day")


def resample(ticks: DataFrame, unit: str) -> DataFrame:
    """Bars of ``unit`` from ticks (symbol, ts, at, value); ``at`` orders the ticks of a bar."""
    bucket = F.date_trunc(unit, "ts").cast("timestamp_ntz")
    return ticks.groupBy("symbol", bucket.alias("bar_ts")).agg(
        F.min_by("value", "at").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "at").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def normalise(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """Provider columns to ours: lower case, renamed, cast; missing volume is 0. Missing prices raise."""
    df = raw.toDF(*[RENAMES.get(c, RENAMES.get(c.lower(), c.lower())) for c in raw.columns])
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(symbol))
    if missing := sorted({"bar_ts", "open", "high", "low", "close"} - {*df.columns}):
        raise ValueError(f"missing columns: {missing}")
    if "volume" not in df.columns:
        df = df.withColumn("volume", F.lit(0.0))
    prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")]
    return df.select("symbol", F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"), *prices, F.col("volume").cast("double").alias("volume"))


def load(spark: SparkSession, source: str, path: str, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from files. ``source``: csv, json, parquet or orc; others raise. ``start`` and ``end`` are inclusive and reach the scan."""
    if source not in ("csv", "json", "parquet", "orc"):
        raise ValueError(f"unknown source: {source}")
    reader = spark.read.option("header", True) if source == "csv" else spark.read
    df = normalise(reader.format(source).load(path), symbol)
    if start is not None:
        df = df.where(F.col("bar_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("bar_ts") <= F.lit(end).cast("timestamp_ntz"))
    return df


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of each symbol."""
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("bar_ts")))
    return bars.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()
