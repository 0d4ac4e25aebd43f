"""Nearest neighbours by inner product with cross-polytope hashing.

A pseudo-rotation of three rounds of random signs and a Hadamard transform turns
a vector; its cell is the nearest signed axis. Several tables have rotations of
their own. A query looks into the cells of its nearest few signed axes in every
table, and all candidates found are scored exactly.

Vectors are split into ranges by their length, powers of two below the longest.
Within a range of different lengths, vectors are made unit vectors by one more
component, so that the angle to a query orders them by inner product. A query
searches every range. Ranges of few entries are scanned whole, since long vectors
are few and near many queries, at any angle; and a query that meets fewer entries
than it asks for is compared with all.

Equal vectors are one entry of the index with their smallest ids, as many as a
result may need. A cell with many entries is split into blocks, and so are the
queries of a cell that many look into; every block of one side meets every block
of the other, so no candidate is lost and no task gets a whole hot cell.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import cut_lineage

TABLES, PROBES, HASHES = 12, 8, 1
#: Ranges of up to so many entries are scanned whole.
SCANNED = 2000
BLOCK = 4096
#: Queries in one task of a scan.
QUERY_BLOCK = 4096
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Coordinates of rows, then their negatives: the scores of all signed axes."""
    width = 1 << max(1, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, table])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    return np.concatenate([y, -y], axis=1)


def cells(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """The ``probes`` best cells of each row in one table, best first; a cell joins ``hashes`` axes."""
    best = score = None
    for part in range(hashes):
        s = rotated(x, table * hashes + part)
        order = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        top = np.take_along_axis(s, order, 1)
        if best is None:
            best, score = order, top
        else:
            best = (best[:, :, None] * s.shape[1] + order[:, None, :]).reshape(len(x), -1)
            score = (score[:, :, None] + top[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            best, score = np.take_along_axis(best, keep, 1), np.take_along_axis(score, keep, 1)
    return best


def usable(v: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _axes(width: int) -> int:
    return 2 << max(1, (width - 1).bit_length())


def _unit(x: np.ndarray, longest: np.ndarray | None) -> np.ndarray:
    """Rows as unit vectors: with ``longest`` given (a logarithm to base 2), by one more component, else by division.

    Rows are scaled before they are squared, so that none overflows or vanishes.
    """
    if longest is None:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    whole = np.floor(longest)
    x = np.ldexp(x, -whole.astype(int)[:, None]) / np.exp2(longest - whole)[:, None]
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])


def _in_cells(same: pa.RecordBatch, g: np.ndarray, t: int, c: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row for each row of ``same`` and each of its cells; ``g`` is given for each row."""
    rows = pa.array(np.repeat(np.arange(same.num_rows), c.shape[1]))
    return pa.RecordBatch.from_arrays([*same.take(rows).columns, pa.array(np.repeat(g, c.shape[1])), pa.array(np.full(len(rows), t, np.int32)), pa.array(c.ravel())], names=names)


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Rows of the vector column ``v`` in double precision."""
    v = batch.column("v")
    flat = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row; where partial sums overflow both ways, the sign of the scaled product decides."""
    with np.errstate(over="ignore", invalid="ignore"):
        z = (x * y).sum(axis=1)
        odd = np.isnan(z)
        if odd.any():
            a, b = (np.abs(m[odd]).max(axis=1) for m in (x, y))
            z[odd] = (x[odd] / a[:, None] * (y[odd] / b[:, None])).sum(axis=1) * a * b
    return z


def best_pairs(x: np.ndarray, y: np.ndarray, first: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``x`` and ``y`` and their inner products: for each row of ``x`` its ``most`` nearest, ties to the smaller ``first``.

    The product of matrices only narrows the choice down: all that may be among
    the nearest in spite of its rounding is scored by itself, which gives the
    same bits wherever a pair is met.
    """
    tall, high = np.abs(x).max(axis=1), np.abs(y).max()
    p, q = x / tall[:, None], y / high  # neither overflows; an order isn't changed
    lengths = np.linalg.norm(p, axis=1), np.linalg.norm(q, axis=1).max()
    with np.errstate(over="ignore"):
        endless = np.finfo(float).max / high / tall * (1 - 1e-9)  # from here on products are infinite, and ties
    for at in range(0, len(x), 512):
        s = p[at : at + 512] @ q.T
        if len(y) > most:
            least = np.partition(s, len(y) - most, axis=1)[:, len(y) - most] - 1e-9 * lengths[0][at : at + 512] * lengths[1]
            i, j = np.nonzero(s >= np.minimum(least, endless[at : at + 512])[:, None])
        else:
            i, j = (m.ravel() for m in np.indices(s.shape))
        i += at
        z = np.concatenate([_inner(x[i[k : k + 50_000]], y[j[k : k + 50_000]]) for k in range(0, len(i), 50_000)])
        order = np.lexsort((first[j], -z, i))
        i, j, z = i[order], j[order], z[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        yield i[place < most], j[place < most], z[place < most]


def _entry_cells(entries: DataFrame, ranges: dict[int, float | None], tables: int, hashes: int) -> DataFrame:
    """(ids, v, g, t, c): a row for each entry and table; ``ranges`` has the logarithm of each range's longest norm, None where all are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                part = whole.slice(at, 2048)
                of = part.column(0).to_numpy()
                for padded in (False, True):
                    mine = np.flatnonzero([(ranges[g] is not None) == padded for g in of.tolist()])
                    if not len(mine):
                        continue
                    g, same = of[mine], part.take(pa.array(mine)).select(["ids", "v"])
                    x = _unit(_matrix(same), np.array([ranges[i] for i in g.tolist()]) if padded else None)
                    for t in range(tables):
                        yield _in_cells(same, g, t, cells(x, t, hashes, 1), ["ids", "v", "g", "t", "c"])

    return entries.where(F.col("g").isin(list(ranges))).select("g", "ids", "v").mapInArrow(run, f"ids array<long>, v {entries.schema['v'].dataType.simpleString()}, g int, t int, c long")


def _query_cells(asked: DataFrame, padded: bool, tables: int, hashes: int, probes: int) -> DataFrame:
    """(qv, v, g, t, c): a row for each query, table and probed cell, for the ranges with or without one more component; g is left at 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                same = whole.slice(at, 2048)
                x = _unit(_matrix(same), None)
                x = np.column_stack([x, np.zeros(len(x))]) if padded else x
                for t in range(tables):
                    yield _in_cells(same, np.zeros(len(x), np.int32), t, cells(x, t, hashes, probes), ["qv", "v", "g", "t", "c"])

    return asked.select("qv", "v").mapInArrow(run, f"qv long, v {asked.schema['v'].dataType.simpleString()}, g int, t int, c long")


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
    hashes: int = HASHES,
) -> DataFrame:
    """The ``k`` nearest found for every row where ``queries`` holds, among all rows of other ids.

    Returns query_id, rank (from 1), vec_id, score: the inner product of the
    original vectors in double precision; ties go to the smaller id.

    Rows with a null id, or a vector that is null, zero, of another width than
    most, or has null or non-finite components, take no part. Repeated rows count
    once. An empty table gives an empty result; other columns are ignored.
    """
    real = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # as short as they come
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{real}>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    valid = whole.where(F.col("id").isNotNull() & usable(F.col("v")))
    widths = valid.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    out = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return vectors.sparkSession.createDataFrame([], out)
    valid = valid.where(F.size("v") == widths["w"]).withColumn("v", F.transform("v", lambda x: (x + F.lit(0.0)).cast(real)))  # no negative zero
    # Of equal vectors no more than k + 1 ids can matter: k results and the query itself.
    first = valid.select("id", "v").distinct().withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = cut_lineage(first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    # Logarithms of lengths; components are divided by the largest before they are squared, so that none overflows or vanishes.
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    scaled = F.aggregate(F.transform("v", lambda x: x.cast("double") / F.col("most")), F.lit(0.0), lambda a, x: a + x * x)
    entries = entries.withColumn("most", most).withColumn("log", F.log2("most") + F.log2(scaled) / 2).drop("most")
    longest = entries.agg(F.max("log")).first()[0]
    entries = entries.withColumn("g", F.greatest(F.floor(F.lit(longest) - F.col("log")), F.lit(0)).cast("int"))
    found_ranges = entries.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("log").alias("shortest"), F.max("log").alias("longest")).collect()
    scanned = [r["g"] for r in found_ranges if r["n"] <= SCANNED]
    ranges = {r["g"]: r["longest"] if r["longest"] > r["shortest"] + 0.0015 else None for r in found_ranges if r["n"] > SCANNED}
    n = sum(r["n"] for r in found_ranges)
    asked = cut_lineage(valid.where("q").groupBy("v").agg(F.min("id").alias("qv")))

    cell, key = ["g", "t", "c"], ["g", "t", "c", "b", "qb"]
    index = _entry_cells(entries, ranges, tables, hashes)
    looked = None
    for padded in (False, True):
        mine = [g for g, most in ranges.items() if (most is not None) == padded]
        if mine:
            # One more component may double the axes; as large a share of the cells is probed.
            more = (_axes(widths["w"] + padded) // _axes(widths["w"])) ** hashes
            made = _query_cells(asked, padded, tables, hashes, probes * more).withColumn("g", F.explode(F.array(*[F.lit(g) for g in mine])))
            looked = made if looked is None else looked.unionByName(made)

    def crowded(side: DataFrame, most: int, name: str) -> DataFrame:
        """Cells of more than ``most`` rows with the number of their blocks: at most rows / ``most`` of them."""
        return side.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*cell, F.ceil(F.col("n") / most).alias(name))

    def dealt(side: DataFrame, split: DataFrame, mine: str, other: str) -> DataFrame:
        """Each row in one block of its own side, for every block of the other side."""
        named = side.join(split, cell, "left")
        own = F.pmod(F.xxhash64("v"), F.coalesce({"b": "blocks", "qb": "qblocks"}[mine], F.lit(1))).alias(mine)
        every = F.explode(F.sequence(F.lit(0), F.coalesce({"b": "blocks", "qb": "qblocks"}[other], F.lit(1)) - 1).cast("array<bigint>")).alias(other)
        return named.select(*cell, own, every, *[c for c in ("ids", "qv", "v") if c in side.columns])

    if looked is not None:
        split = cut_lineage(crowded(index, BLOCK, "blocks").join(crowded(looked, QUERY_BLOCK, "qblocks"), cell, "full"))
        index, looked = dealt(index, split, "b", "qb"), dealt(looked, split, "qb", "b")

    form = "qv long, vec_id long, score double"

    def rerank(q: pa.Table, e: pa.Table) -> pa.Table:
        made = []
        if q.num_rows and e.num_rows:
            ids = e.column("ids").combine_chunks()
            starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            qv = q.column("qv").to_numpy()
            for i, j, z in best_pairs(_matrix(q), _matrix(e), flat[starts[:-1]], k + 1):
                n = starts[j + 1] - starts[j]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                made.append((np.repeat(qv[i], n), flat[np.repeat(starts[j], n) + within], np.repeat(z, n)))
        columns = [np.concatenate(c) for c in zip(*made, strict=True)] or [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["qv", "vec_id", "score"])

    def scan(some: DataFrame, n_asked: int, those: DataFrame, n_entries: int) -> DataFrame:
        """Each block of queries against each block of entries."""
        across, down = -(-n_asked // QUERY_BLOCK) or 1, -(-n_entries // BLOCK) or 1
        all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        q = some.select("qv", "v", F.pmod(F.xxhash64("v"), F.lit(across)).cast("int").alias("qb")).select("*", all_of(down).alias("eb"))
        e = those.select("ids", "v", F.pmod(F.xxhash64("v"), F.lit(down)).cast("int").alias("eb")).select("*", all_of(across).alias("qb"))
        return q.groupBy("qb", "eb").cogroup(e.groupBy("qb", "eb")).applyInArrow(rerank, form)

    parts = [] if looked is None else [looked.groupBy(*key).cogroup(index.groupBy(*key)).applyInArrow(rerank, form)]
    if scanned:
        parts.append(scan(asked, asked.count(), entries.where(F.col("g").isin(scanned)), sum(r["n"] for r in found_ranges if r["g"] in scanned)))
    found = functools.reduce(DataFrame.unionByName, parts)
    distinct = found.groupBy("qv", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), "vec_id"]
    best = distinct.withColumn("n", F.row_number().over(W.partitionBy("qv").orderBy(*order))).where(F.col("n") <= k + 1).drop("n")
    if ranges:
        # Queries that met too few are compared with all entries.
        best = cut_lineage(best)
        least = min(k + 1, entries.agg(F.sum(F.size("ids"))).first()[0])
        enough = best.groupBy("qv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        short = cut_lineage(asked.join(enough, "qv", "left_anti"))
        n_short = short.count()
        if n_short:
            whole = scan(short, n_short, entries, n).groupBy("qv", "vec_id").agg(F.max("score").alias("score"))
            best = best.join(short, "qv", "left_anti").unionByName(whole)
    by_query = valid.where("q").select("id", "v").distinct().join(asked, "v").select(F.col("id").alias("query_id"), "qv")
    each = by_query.join(best, "qv").where("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_report(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 20."""
    return nearest(embeddings, F.col("vec_id") % 20 == 0)
