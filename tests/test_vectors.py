"""Exact vector search against brute force, on clustered, random and odd vectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as spark_types

from barloom.operators import vectors


def plain(rows, asked, k):
    ids = np.array([i for i, v in rows if v is not None])
    x = np.array([v for _, v in rows if v is not None], float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = []
    for q in asked:
        if q not in ids:
            continue
        s = np.round(x @ x[list(ids).index(q)], 9)
        best = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
        out += [(int(q), int(i), n + 1, round(float(-v), 6) + 0.0) for n, (v, i) in enumerate(best)]
    return sorted(out)


def found(spark, rows, asked, k):
    v = spark.createDataFrame([(int(i), None if x is None else [float(y) for y in x], "c") for i, x in rows], "vec_id long, embedding array<double>, cell string").repartition(4)
    made = vectors.vector_top(v, v.where(v.vec_id.isin([int(a) for a in asked])), k)
    return sorted((r.query_id, r.vec_id, r["rank"], round(r.score, 6) + 0.0) for r in made.collect())


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 30)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, centres[i % 12] + spread * rng.normal(size=8)) for i in range(900)]
    rows += [(1000 + i, rows[5][1] * (i + 1)) for i in range(15)] + [(2000, np.zeros(8)), (2001, np.zeros(8)), (2002, None), (2003, -rows[5][1])]
    asked = [*range(0, 900, 40), 5, 1003, 2000, 2002]
    assert found(spark, rows, asked, 10) == plain(rows, asked, 10)


def test_clusters_are_left_out(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.02 * rng.normal(size=16)).tolist()) for i in range(4000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert vectors.share_scored(v, v.where("vec_id % 50 = 0"), 10) < 0.2


def test_small_and_empty_tables(spark):
    assert found(spark, [(1, [1.0, 0.0])], [1], 3) == []
    assert found(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [1], 3) == [(1, 2, 1, 0.0)]
    assert found(spark, [(1, [0.0, 0.0]), (2, [0.0, 0.0])], [2], 3) == [(2, 1, 1, 0.0)]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vectors.vector_top(none, none).count() == 0


def test_python_holds_slices(monkeypatch):
    """A batch of queries that visits every cell is given out by slices of bounded size, whole and in order."""
    monkeypatch.setattr(vectors, "HELD", 20_000)
    rng = np.random.default_rng(5)
    cells = vectors.Cells(vectors._unit(rng.normal(size=(50, 8))), np.array([3] * 50 + [0]), np.full(51, 3.0))

    class Asked:
        schema = spark_types.StructType.fromDDL("id long, v array<double>, least double")

        def mapInArrow(self, run, _):
            return run

    v = rng.normal(size=(3000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(v.tolist(), pa.list_(pa.float64())), pa.array([-2.0] * 3000)], names=["id", "v", "least"])
    first, later = (list(f(Asked(), cells, 5)(iter([batch]))) for f in (vectors.first_visits, vectors.later_visits))
    assert max(b.num_rows * 8 for b in first + later) <= 20_000
    seen = [(i, c) for b in first + later for i, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
    assert len(seen) == len(set(seen)) == 3000 * 50 and [i for b in first for i in b.column(0).to_pylist()] == sorted(i for b in first for i in b.column(0).to_pylist())
