"""Tables written in the folder that driver and executors share, and numbers over all rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without that setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that it is made once and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table that is sent to all tasks; it should have narrow rows.
SENT_ROWS = 200_000


def sent_if_few(df: DataFrame) -> DataFrame:
    """``df`` materialised and, if it has few rows, marked to be sent to all tasks, so that what it joins isn't shuffled."""
    held = cut_lineage(df)
    return F.broadcast(held) if held.limit(SENT_ROWS + 1).count() <= SENT_ROWS else held


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, *order: str, out: str = "number") -> DataFrame:
    """Adds ``out``, the row's place from 0 in the order of all rows.

    Rows are dealt by ranges of the order and sorted within each, so no task sees all of
    them; a table with one row for each range holds how many rows the ranges before have.
    Rows alike in ``order`` get different numbers in any order; nulls come first.
    """
    index = F.monotonically_increasing_id()
    held = cut_lineage(df.repartitionByRange(parts(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("__at", index))
    piece, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = held.groupBy(piece.alias("__piece")).count()
    # One row for each range, as many as the session has shuffle partitions.
    offsets = sizes.select("__piece", (F.sum("count").over(W.orderBy("__piece").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("__before"))
    made = held.withColumn("__piece", piece).join(F.broadcast(offsets), "__piece")
    return made.withColumn(out, F.col("__before") + row).drop("__at", "__piece", "__before")


#: Digits of a digest that one round of counting looks at, and how many rows may be compared whole.
DIGITS, FEW = 3, 4096


def nth_digest(digests: DataFrame, n: int, width: int = 32) -> tuple[str | None, int]:
    """The n-th smallest (from 1) of the hexadecimal ``digest`` column, and how many rows are smaller.

    Rows are counted by the first digits, then by the next ones among those with the
    right first digits, until few are left: each round counts in Spark and brings 4,096
    numbers to the driver at most. None if there are fewer rows.
    """
    known, smaller = "", 0
    while True:
        rest = digests.where(F.col("digest").startswith(known)) if known else digests
        at = len(known)
        if at >= width:
            return known, smaller
        counts = {r.p: r["count"] for r in rest.groupBy(F.substring("digest", at + 1, DIGITS).alias("p")).count().collect()}
        for p in sorted(counts):
            if smaller + counts[p] >= n:
                known += p
                break
            smaller += counts[p]
        else:
            return None, smaller
        if counts[known[at:]] <= FEW:
            rows = digests.where(F.col("digest").startswith(known)).groupBy("digest").count().orderBy("digest").collect()  # FEW at most
            for r in rows:
                if smaller + r["count"] >= n:
                    return r.digest, smaller
                smaller += r["count"]
