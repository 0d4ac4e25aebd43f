"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and everything runs in one local process
    (tests, a laptop) a temporary folder takes its place; a cluster without the
    setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Narrow rows, and rows with a text's shingles, that one task writes where it is known about how many there are.
NARROW_LOT, WIDE_LOT = 1 << 18, 1 << 13


def tasks_for(spark: SparkSession, rows: int, lot: int = NARROW_LOT) -> int:
    """Tasks for so many rows, one for each core at least."""
    return max(1, spark.sparkContext.defaultParallelism, -(-rows // lot))


def cut_lineage(df: DataFrame, rows: int | None = None, lot: int = NARROW_LOT) -> DataFrame:
    """Materialise ``df`` in the shared folder; lost executors cannot lose it.

    With ``rows``, about how many there are at most, no more tasks write than these
    take. Every task writes a file and its checksum, and where Hadoop's native library
    is missing an executor's process splits off a chmod for each of both, whose memory
    is the executor's own once more until it has started.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(tasks_for(df.sparkSession, rows, lot))).checkpoint(eager=True)


def drop(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library has written and nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
