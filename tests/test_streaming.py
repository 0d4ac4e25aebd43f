import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators
from barloom.sources import bars as source
from barloom.streaming import bars as streaming

SCHEMA = "symbol string, ts timestamp_ntz, value double"


def test_bars_are_those_of_the_batch(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 1, i // 4, i % 4 * 10), float(i % 7 + 1)) for i in range(40)]
    ticks = spark.createDataFrame(rows, SCHEMA)
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    made = streaming.windowed(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    q = made.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    expect = source.resample(ticks.withColumn("at", F.struct("ts", "value")), "hour")
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, expect.collect()))


def test_running_mean_is_that_of_the_batch(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 1, i), 1.0, 1.0, 1.0, float(i % 5 + 1), 1) for i in range(20)]
    schema = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume bigint"
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = streaming.running_ema(stream, 5)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = [r.ema for r in spark.read.parquet(str(tmp_path / "out")).orderBy("bar_ts").collect()]
    expect = [r.ema for r in indicators.ema(spark.createDataFrame(rows, schema), 5).orderBy("bar_ts").collect()]
    assert got == pytest.approx(expect)
