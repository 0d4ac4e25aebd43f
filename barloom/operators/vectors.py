"""Exact nearest neighbours by cosine, with pivots that leave out what can't be near.

A bounded number of the vectors are pivots; each vector lies in the cell of the pivot
at the smallest angle. Angles obey the triangle inequality, so no vector of a cell whose
members lie within an angle r of its pivot is nearer to a query than the query's angle
to the pivot less r. A query first visits the nearest cells, until they hold enough
vectors; the k-th nearest of these bounds what is still of interest, and only the cells
that may hold something nearer are visited after that. Nothing is lost: a cell is left
out by its bound alone.

How much is left out depends on the vectors: clustered ones are cut to a few cells,
random ones of many components to hardly less than all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.shared import cut_lineage

#: Pivots at most, and rows of a block of queries and of vectors.
PIVOTS, QUERY_BLOCK, VECTOR_BLOCK = 1024, 1000, 20_000
#: Numbers that a Python task holds in one array, so that its memory doesn't grow with queries, cells or vectors.
HELD = 2_000_000
#: Scores are compared at nine places; bounds are wider than that.
SLACK = 1e-7


@dataclass(frozen=True)
class Cells:
    """Pivots as unit rows and, for each cell, its number of vectors and the largest angle to the pivot; the last cell holds zero vectors."""

    pivots: np.ndarray
    sizes: np.ndarray
    reach: np.ndarray

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """For each query (a row) the highest cosine that each cell may hold; -inf for an empty cell."""
        angle = np.arccos(np.clip(unit @ self.pivots.T, -1, 1))
        made = np.cos(np.maximum(0.0, angle - self.reach[:-1]))
        made[~unit.any(axis=1)] = 0.0  # a zero query has a cosine of 0 to all
        made = np.column_stack([made, np.zeros(len(unit))])
        made[:, self.sizes == 0] = -np.inf
        return made


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-300)  # no square overflows
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _slices(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows, each of as many as ``HELD`` numbers allow with ``width`` numbers a row."""
    step = max(1, HELD // max(1, width))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _in_cells(base: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, angle) with v as a unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _slices(batch.num_rows, max(pivots.shape)):
                ids = batch.column(0).slice(at.start, at.stop - at.start)
                v = _unit(_stacked(batch.column(1).slice(at.start, at.stop - at.start)))
                cosine = v @ pivots.T
                cell = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(v)), cell], -1, 1))
                zero = ~v.any(axis=1)
                cell, angle = np.where(zero, len(pivots), cell), np.where(zero, 0.0, angle)
                yield pa.RecordBatch.from_arrays([ids, _lists(v), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["id", "v", "cell", "angle"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, v array<double>, cell int, angle double")


def cells_of(base: DataFrame) -> tuple[DataFrame, Cells]:
    """(id, v) in cells, and what is known of the cells: at most ``PIVOTS`` rows reach the driver."""
    n = base.count()
    wanted = max(1, min(PIVOTS, math.isqrt(n)))
    rows = base.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    pivots = _unit(np.array([r.v for r in rows])) if rows else np.zeros((1, len((base.first() or [0, [0.0]])[1])))
    held = cut_lineage(_in_cells(base, pivots))
    sizes, reach = np.zeros(len(pivots) + 1, np.int64), np.zeros(len(pivots) + 1)
    for r in held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("most")).collect():
        sizes[r.cell], reach[r.cell] = r.n, r.most
    return held, Cells(pivots, sizes, reach)


def _visits(asked: DataFrame, cells: Cells, chosen: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(id, v, cell) of each query in the cells that ``chosen`` marks: bounds from high to low, vectors in the cells before, and rows of queries.

    A query's vector goes to each of its cells, so rows are given out by slices: a query
    that visits all cells takes as many rows as there are cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _slices(batch.num_rows, len(cells.sizes) * cells.pivots.shape[1]):
                part = batch.slice(at.start, at.stop - at.start)
                v = _unit(_stacked(part.column(1)))
                bounds = cells.bounds(v)
                order = np.argsort(-bounds, axis=1, kind="stable")
                sizes = cells.sizes[order]
                row, place = np.nonzero(chosen(np.take_along_axis(bounds, order, axis=1), np.cumsum(sizes, axis=1) - sizes, part) & (sizes > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), _lists(v[row]), pa.array(order[row, place].astype(np.int32))], names=["id", "v", "cell"])

    return asked.mapInArrow(run, f"id {asked.schema['id'].dataType.simpleString()}, v array<double>, cell int")


def first_visits(asked: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(id, v, cell): each query in its most promising cells, until they hold more than k vectors."""
    return _visits(asked, cells, lambda bounds, before, rows: before < k + 1)


def later_visits(asked: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(id, v, cell): each query in the cells that may hold something as near as ``least``, but for those of the first visit."""
    return _visits(asked, cells, lambda bounds, before, rows: (before >= k + 1) & (bounds >= rows.column(2).to_numpy(zero_copy_only=False).reshape(-1, 1) - SLACK))


def _best(visits: DataFrame, held: DataFrame, cells: Cells, k: int, query_type: str, id_type: str) -> DataFrame:
    """(query_id, vec_id, score): of each visited cell a query's k best, by blocks of bounded size."""
    parts = F.element_at(F.array(*[F.lit(int(-(-s // VECTOR_BLOCK) or 1)) for s in cells.sizes]), F.col("cell") + 1)
    base = held.withColumn("vb", F.pmod(F.xxhash64("id"), parts).cast("int"))
    counts = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("n"))  # at most PIVOTS rows
    dealt = visits.join(F.broadcast(counts), "cell").withColumn("qb", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    asked = dealt.withColumn("vb", F.explode(F.sequence(F.lit(0), parts - 1))).select("cell", "vb", "qb", "id", "v")
    there = base.join(F.broadcast(counts), "cell").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("cell", "vb", "qb", "id", "v")

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(q) and len(v):
            ids, asked_ids, most = v["id"].to_numpy(), q["id"].to_numpy(), min(k + 1, len(v))
            x, y = np.stack(q["v"].to_numpy()), np.stack(v["v"].to_numpy()).T
            for at in _slices(len(q), len(v)):
                for i, s in zip(asked_ids[at], x[at] @ y, strict=True):
                    r = np.round(s, 9)
                    near = np.flatnonzero(r >= np.partition(r, len(r) - most)[len(r) - most])  # ties of the last one included
                    order = near[np.lexsort((ids[near], -r[near]))][:most]
                    rows += [(i, ids[j], s[j]) for j in order if ids[j] != i]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    keys = ["cell", "vb", "qb"]
    return asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(best, f"query_id {query_type}, vec_id {id_type}, score double")


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest by cosine for each query, other ids only, ties to the smaller id.

    Exact. Null vectors take no part; a zero vector has a cosine of 0 to all.
    """
    shaped = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    base, asked = shaped(vectors), shaped(queries)
    kinds = [d.schema["id"].dataType.simpleString() for d in (asked, base)]
    held, cells = cells_of(base)
    near = cut_lineage(_best(first_visits(asked, cells, k), held, cells, k, *kinds))
    bound = near.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") <= k)
    bound = bound.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(-2.0)).alias("least"))
    open_ = asked.join(bound.withColumnRenamed("query_id", "id"), "id", "left").select("id", "v", F.coalesce("least", F.lit(-2.0)).alias("least"))
    found = near.unionByName(_best(cut_lineage(later_visits(open_, cells, k)), held, cells, k, *kinds))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def share_scored(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of all pairs of query and vector that :func:`vector_top` scores."""
    shaped = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    base, asked = shaped(vectors), shaped(queries)
    held, cells = cells_of(base)
    last = vector_top(vectors, queries, k, id_col, vector_col).groupBy("query_id").agg(F.min("score").alias("least")).withColumnRenamed("query_id", "id")
    both = first_visits(asked, cells, k).unionByName(later_visits(asked.join(last, "id"), cells, k))
    met = sum(r["count"] * int(cells.sizes[r.cell]) for r in both.groupBy("cell").count().collect())
    return met / max(1, asked.count() * held.count())
