import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import ann


def brute_force(rows, k=20):
    out = {}
    for i, v in rows.items():
        if i % 20 == 0:
            scored = sorted((-float(np.dot(v, w)), j) for j, w in rows.items() if j != i)
            out[i] = scored[:k]
    return out


@pytest.mark.parametrize("uneven", [False, True])
def test_recall_and_order(spark, uneven):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if uneven:
        x *= rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    x[100:180] = x[0]
    rows = {i: v.astype(np.float64) for i, v in enumerate(x)}
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(2000, [0.0] * 24, 1), (2020, None, 1), (2040, [1.0] * 23 + [None], 1), (2060, [float("nan")] * 24, 1), (None, [1.0] * 24, 1), (2080, [1.0], 1), (2081, [float("inf")] * 24, 1), data[0], data[7]]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest_report(df).collect():
        got.setdefault(r.query_id, []).append(r)
    expect = brute_force(rows)
    assert set(got) == set(expect)
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21))
        assert all(abs(r.score - np.dot(rows[q], rows[r.vec_id])) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        least = -expect[q][-1][0] - 1e-9
        hits += sum(r.score >= least for r in found)
    assert hits / (20 * len(expect)) >= 0.9
    if uneven:
        return
    assert [r.vec_id for r in sorted(got[0], key=lambda r: r.rank)] == list(range(100, 120))
    assert [r.vec_id for r in sorted(got[100], key=lambda r: r.rank)] == [0, *range(101, 120)]


def test_blocks_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.nearest_report(df).collect()))
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert sorted(map(tuple, ann.nearest_report(df).collect())) == whole
    monkeypatch.setattr(ann, "SCANNED", 0)
    monkeypatch.setattr(ann, "BLOCK", 1 << 20)
    in_cells = sorted(map(tuple, ann.nearest_report(df).collect()))
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, ann.nearest_report(df).collect())) == in_cells


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest_report(spark.createDataFrame([], schema)).count() == 0
    few = ann.nearest_report(spark.createDataFrame([(20, [1.0, 0.0]), (3, [0.5, 0.5]), (40, [-1.0, 0.0])], schema)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in few) == [(20, 1, 3, 0.5), (20, 2, 40, -1.0), (40, 1, 3, -0.5), (40, 2, 20, -1.0)]
    assert ann.nearest_report(spark.createDataFrame([(20, [1.0, 0.0])], schema)).count() == 0


@pytest.mark.parametrize("kind", ["lognormal", "one long"])
def test_recall_on_very_uneven_lengths(spark, kind, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rng.lognormal(size=(6000, 1)) if kind == "lognormal" else 1
    if kind == "one long":
        x[7] *= 100
    monkeypatch.setattr(ann, "SCANNED", 500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = list(range(0, 6000, 40))
    got = {}
    for r in ann.nearest(df, ann.F.col("vec_id") % 40 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    hits = sum(len(set(np.argsort(-s)[:20]) & set(got[q])) for q, s in zip(asked, scores, strict=True))
    assert all(len(got[q]) == 20 for q in asked) and hits / (20 * len(asked)) >= 0.9


def test_queries_with_few_candidates_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "SCANNED", 0)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, ann.F.col("vec_id") < 10, tables=1, probes=1).collect()
    assert len(got) == 200
    for q in range(10):
        s = x[q] @ x.T
        s[q] = -np.inf
        assert {r.vec_id for r in got if r.query_id == q} == set(np.argsort(-s)[:20])


def test_ties_go_to_the_smaller_id(spark):
    """All inner products are equal: every cell holds the same scores, and the smallest ids must win."""
    rng = np.random.default_rng(5)
    n, width = 3300, 16
    rest = rng.choice([-1.0, 1.0], (n, width - 1)) * 2.0
    rest = np.unique(rest, axis=0)
    rows = [(i + 1, [1.0, *r.tolist()]) for i, r in enumerate(rest)] + [(100_000, [4.0] + [0.0] * (width - 1))]
    made = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 100_000, tables=2, probes=32)
    got = [(r["rank"], r.vec_id, r.score) for r in made.orderBy("rank").collect()]
    assert got == [(i, i, 4.0) for i in range(1, 21)]


def test_best_pairs_are_the_plain_rule():
    rng = np.random.default_rng(6)
    x, y = rng.integers(-2, 3, (40, 6)).astype(float), rng.integers(-2, 3, (500, 6)).astype(float)
    first = rng.permutation(500)
    for most in (1, 5, 21, 600):
        got = {}
        for i, j, z in ann.best_pairs(x, y, first, most):
            for a, b, c in zip(i, j, z):
                got.setdefault(a, []).append((-c, first[b]))
        for a in range(40):
            assert got[a] == sorted((-float(x[a] @ y[b]), first[b]) for b in range(500))[:most]


def test_vectors_of_extreme_length(spark, monkeypatch):
    """Finite and not zero, so they take part; products that overflow are infinite."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 6))
    scale = [1e-200, 1e-160, 1.0, 1e150, 1e200, 5e-324]
    rows = [(i, (base[i] * scale[i % 6]).tolist()) for i in range(60)] + [(100, [1e200, -1e200, 0.0, 0.0, 0.0, 0.0]), (101, [1e200, 1.1e200, 0.0, 0.0, 0.0, 0.0])]
    rows = [(i, v) for i, v in rows if any(v)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    vectors = dict(rows)
    for most in (2000, 0):
        monkeypatch.setattr(ann, "SCANNED", most)
        got = {}
        for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 5).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q in [i for i in vectors if i % 20 == 0]:
            assert [x[0] for x in sorted(got[q])] == [1, 2, 3, 4, 5]
            if most:
                exact = ann._inner(np.array([vectors[q]] * len(rows)), np.array([v for _, v in rows]))
                best = sorted((-s, i) for s, (i, _) in zip(exact, rows) if i != q)[:5]
                assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in best]
    assert ann._inner(np.array([[1e200, 1e200]]), np.array([[1e200, -1.1e200]]))[0] == -np.inf
