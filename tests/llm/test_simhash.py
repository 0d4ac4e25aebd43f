import re

import numpy as np
import pytest
import xxhash

from barloom.llm import components, simhash


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(values):
    parent = list(range(len(values)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in enumerate(values):
        for j in range(i):
            if bin(x ^ values[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def test_report_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)] + ["É", "ß", "A B", "\x1c", "x\x85y"]
    texts = [None, "", "one", "One two", "\t \n"]
    for _ in range(40):
        base = list(rng.choice(words, 120))
        texts.append(" ".join(base))
        for _ in range(4):
            edited = list(base)
            edited[rng.integers(120)] = "new"
            texts.append(" ".join(edited))
    texts += texts[5:9]
    docs = spark.createDataFrame([(i + 10, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.simhash_report(docs).collect()}
    plain = [plain_fingerprint(t) for t in texts]
    roots = plain_components(plain)
    assert len(got) == len(texts) and len(set(roots)) < len(texts) - 20
    for i in range(len(texts)):
        assert got[i + 10].fingerprint == f"{plain[i]:016x}" and got[i + 10].component_id == roots[i] + 10


def test_links_of_random_close_fingerprints(spark):
    rng = np.random.default_rng(5)
    values = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for v in values[:40]:
        for n in (1, 2, 3, 4):
            values.append(v ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    linked = {r.fp: r.root for r in simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    roots = plain_components(values)
    groups = {}
    for v, r in zip(signed, roots, strict=True):
        groups.setdefault(r, set()).add(linked[v])
    assert all(len(g) == 1 for g in groups.values()) and len({*linked.values()}) == len(groups)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (500, 501), (500, 501)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 501: 500}


@pytest.mark.parametrize("lot", [0, 40, components.LOT])
def test_components_at_once_and_by_rounds(spark, monkeypatch, lot):
    monkeypatch.setattr(components, "LOT", lot)
    rng = np.random.default_rng(3)
    pairs = [(int(x), int(y)) for x, y in rng.integers(-200, 200, (150, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    joined = {x: {x} for p in pairs for x in p}
    for x, y in pairs:
        if joined[x] is not joined[y]:
            joined[x] |= joined[y]
            joined.update(dict.fromkeys(joined[y], joined[x]))
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs * 2, "a long, b long")).collect()}
    assert got == {x: min(of) for x, of in joined.items() if x != min(of)}


def test_few_edges_take_few_tasks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long").repartition(40).localCheckpoint()
    context = spark.sparkContext
    context.setJobGroup("few-edges", "")
    try:
        assert components.components(edges).count() == 100
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    told = context.statusTracker()
    jobs = [told.getJobInfo(j) for j in told.getJobIdsForGroup("few-edges")]
    # 40 write the edges and few read them; by rounds of stars it took 149
    assert sum(told.getStageInfo(s).numCompletedTasks for s in {s for j in jobs for s in j.stageIds}) < 60


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string"
    assert simhash.simhash_report(spark.createDataFrame([], schema)).count() == 0
    rows = simhash.simhash_report(spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 3), (3, 3), (3, 3)]


def test_very_long_text(spark):
    """Longer than one block of shingles; one word more or less changes few bits."""
    rng = np.random.default_rng(9)
    text = " ".join(f"w{i}" for i in rng.integers(0, 50_000, 200_000))
    rows = simhash.simhash_report(spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")).collect()
    assert {r.component_id for r in rows} == {1}
    assert simhash.fingerprint(text) == plain_fingerprint(text)
