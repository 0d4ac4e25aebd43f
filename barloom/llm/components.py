"""Connected components of an edge table: at once where edges are few, else by alternating large-star and small-star steps.

Up to ``LOT`` edges one task joins by itself. Of more, each step is a group-by and
a join over all tasks and every round is materialised in the shared folder, which
takes a dozen stages a round however few edges there are. At the end each node of a
component points at its smallest node.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut_lineage, tasks_for

#: Edges that one task joins by itself, in some 20 MB.
LOT = 1 << 16
CHUNK = 1 << 14


class Joined:
    """Which items belong together, by the smallest of each set."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart until now."""
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, root) of edges that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                joined.join(x, y)
        nodes = [*joined.up]  # all but the roots
        for at in range(0, len(nodes), CHUNK):
            some = nodes[at : at + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([*map(joined.top, some)], pa.int64())], names=["node", "root"])

    return cut_lineage(edges.coalesce(1).mapInArrow(run, "node long, root long"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges point down: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    down = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``edges`` has columns a and b (long). Returns (node, root) for every node that isn't its own root.

    An empty edge table gives an empty result; repeated edges and loops are harmless.
    With ``rows``, about how many edges there are at most, no more tasks write them than these take.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Shuffled, since what makes the edges is to keep its tasks.
    now = cut_lineage(edges if rows is None else edges.repartition(tasks_for(edges.sparkSession, rows)))
    cores = max(1, edges.sparkSession.sparkContext.defaultParallelism)
    seen = None
    for _ in range(rounds):
        # No more tasks than cores: the rows are read and counted only.
        mark = tuple(now.coalesce(cores).agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if mark[0] <= LOT:
            return _at_once(now)
        seen = mark
        now = cut_lineage(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
