import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barloom import queries


def test_hybrid_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 150
    x = rng.normal(size=(n, 8)).astype(np.float32)
    texts = [" ".join(rng.choice([f"w{c}" for c in "abcdefghij"], 6)) + f" no {i}" for i in range(n)]
    for i in range(20, 40):
        texts[i] = "same head " * 12 + str(i)
    pq.write_table(pa.table({"vec_id": list(range(n)), "embedding": x.tolist(), "label": [0] * n}), f"{tmp_path}/embeddings.parquet")
    pq.write_table(pa.table({"doc_id": list(range(n)), "text": texts}), f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.queries()["hybrid_topk"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    tokens = [set(re.findall(r"[a-z]+|\d+", t)) for t in texts]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert set(got) == {0, 50, 100}
    for q, found in got.items():
        d = 1 - u @ u[q]
        hits = [j for j in np.argsort(d, kind="stable") if j != q][:30]
        scored, heads = [], set()
        for j in hits:
            if texts[j][:100] not in heads:
                heads.add(texts[j][:100])
                scored.append((0.7 * (1 - d[j] / d[hits[-1]]) + 0.3 * len(tokens[q] & tokens[j]) / len(tokens[q]), j))
        scored.sort(key=lambda p: (-p[0], p[1]))
        assert [f[0] for f in found] == [j for _, j in scored[:10]]
        assert [f[1] for f in found] == pytest.approx([s for s, _ in scored[:10]], abs=6e-7)  # the query shows six places
