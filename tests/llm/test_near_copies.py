import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType

import corpus_pipeline
from barloom.llm import near_copies
from tests.llm.test_pipeline import make


def similarity(a, b):
    x, y = (set(near_copies.shingles(near_copies._words(t)).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_stage_keeps_one_of_every_pair_of_near_copies(spark, tmp_path):
    make(tmp_path)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(500)]
    rows = [(None, "a b c d e"), (900, "  "), (901, None), (902, "a b c d e"), (902, "a b c d e"), (903, "A b c\td e")]
    for g in range(30):
        base = list(rng.choice(words, 200))
        for c in range(4):
            text = list(base)
            for at in rng.choice(200, c * (1 + g % 3), replace=False):
                text[at] = "new"
            rows.append((g * 10 + c, " ".join(text)))
    dense = list(rng.choice(words, 150))
    rows += [(1000 + i, " ".join([*dense[:-1], f"last{i}"])) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, str(tmp_path)).collect()]
    texts = {i: t or "" for i, t in rows if i is not None}
    ids = sorted(texts)
    root = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    expect = [i for i in ids if root[i] == i]
    assert sorted(i for i in got if i is not None) == sorted([*expect, 902]) and got.count(None) == 1
    assert len(expect) < len(ids) - 100


@pytest.mark.parametrize("n_texts,least", [(1000, 0.97), (1 << 20, 0.93), (1 << 30, 0.9)])
def test_keys_of_close_fingerprints_meet(n_texts, least):
    """By the documented chances for each width: own values of one among the ball of the other."""
    rng = np.random.default_rng(2)
    width = near_copies.width_for(n_texts)
    for n, k, wanted in ((200, 22, least), (200, 10, 0.99), (1000, 111, least)):
        met = 0
        for _ in range(150):
            s = rng.integers(0, 1 << 63, n + k, dtype=np.uint64)
            a, b = (near_copies.entry(near_copies.margins(part), width) for part in (s[:n], s[k:]))
            x, y = near_copies.keys(np.stack([a[0], b[0]]), np.stack([a[1], b[1]]), width)
            met += bool(set(x[:, 0].tolist()) & set(y.ravel().tolist()) or set(y[:, 0].tolist()) & set(x.ravel().tolist()))
            assert np.bitwise_count((a[0] ^ b[0]).view(np.uint64)).sum() <= near_copies.MAX_BITS
        assert met / 150 >= wanted


def joined_by(pairs):
    tops = {}
    top = lambda x: x if tops.get(x, x) == x else top(tops[x])
    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        tops[y] = x
    return {x: top(x) for p in pairs for x in p}


def test_edges_join_what_every_pair_of_a_value_joins(spark, monkeypatch):
    """Nodes of different roots with an own entry, whatever the size of the blocks."""
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 62, (40, 8)) & 3
    nodes = spark.createDataFrame([(i, prints[i].tolist()) for i in range(40)], "node long, fp array<long>")
    rows = sorted({(int(k), int(n)) for k, n in zip(rng.choice([1, 1, 1, 2, 3, 4], 90), rng.integers(0, 40, 90))})
    entries = [(k, n, bool((k + n) % 3), n % 5, sum(x == k for x, _ in rows)) for k, n in rows]
    apart = spark.createDataFrame(entries, "key long, node long, own boolean, root long, n long").repartition(3)
    bits = lambda a, b: sum(int(x ^ y).bit_count() for x, y in zip(prints[a].tolist(), prints[b].tolist()))
    for most in (3, 5, 8):
        monkeypatch.setattr(near_copies, "MAX_BITS", most)
        expect = {(a[1], b[1]) for a in entries for b in entries if a[0] == b[0] and a[1] < b[1] and a[3] != b[3] and (a[2] or b[2]) and bits(a[1], b[1]) <= most}
        for block, together in ((512, 256), (8, 4), (2, 1)):
            monkeypatch.setattr(near_copies, "BLOCK", block)
            monkeypatch.setattr(near_copies, "TOGETHER", together)
            got = [(r.a, r.b) for r in near_copies._clouds(apart, nodes).collect()]
            assert {tuple(sorted(p)) for p in got} <= expect and joined_by(got) == joined_by(sorted(expect))


def test_a_cloud_of_texts_on_both_sides_of_the_limit(spark, monkeypatch):
    """Many short variants of one text, some similar enough and most not: no link is lost, however the cloud is cut."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(45)]
    rows = []
    for i in range(120):
        text = list(base)
        for at in rng.choice(45, int(rng.integers(1, 4)), replace=False):
            text[at] = f"x{rng.integers(0, 4)}"
        rows.append((i, " ".join(text)))
    kept = sorted(r.doc_id for r in near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    links = [(a, b) for a in range(120) for b in range(a) if similarity(rows[a][1], rows[b][1]) >= near_copies.LEAST]
    tops = joined_by(links)
    assert kept == [i for i in range(120) if tops.get(i, i) == i] and 5 < len(kept) < 115


def test_margins_are_the_plain_count():
    s = np.random.default_rng(3).integers(0, 1 << 63, 300, dtype=np.uint64)
    mask = (1 << 64) - 1
    for bit in (0, 63, 64, 200, 479):
        total = 0
        for h in s.tolist():
            m = (h * int(near_copies.FACTORS[0][bit // 64]) + int(near_copies.SHIFTS[0][bit // 64])) & mask
            m = ((m ^ (m >> 31)) * int(near_copies.FACTORS[1][bit // 64]) + int(near_copies.SHIFTS[1][bit // 64])) & mask
            total += 1 if (m ^ (m >> 29)) >> (bit % 64) & 1 else -1
        assert near_copies.margins(s)[bit] == total


def test_empty_and_very_long(spark, tmp_path):
    schema = "doc_id long, text string, node string"
    assert near_copies.keep_first(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(100_000))
    kept = near_copies.keep_first(spark.createDataFrame([(2, long, "x"), (1, long + " end", "x"), (3, "a b", "y"), (4, "a b c", "z")], schema))
    assert sorted(map(tuple, kept.collect())) == [(1, long + " end", "x"), (3, "a b", "y"), (4, "a b c", "z")]


def test_filters_reach_the_driver_in_parts(spark, monkeypatch):
    values = [7, 123_456_789_012, -5, 134_217_688]
    df = spark.createDataFrame([(v,) for v in values], "node long")

    def whole(self):
        raise AssertionError("a filter is collected whole")

    monkeypatch.setattr(type(df), "collect", whole)
    bits = near_copies._filter(df, "node").value.bits()
    assert near_copies._passes(bits, np.array(values)).all() and not near_copies._passes(bits, np.array([8, 9, 10])).any()
    assert np.unpackbits(bits).sum() == 2 * len(values)


def test_workers_hold_the_words_of_few_texts(spark):
    """Whatever the batch; before, words of all its texts lay in memory, some 75 MB here."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 500)) for _ in range(3000)]
    base = SimpleNamespace(schema={"id": SimpleNamespace(dataType=LongType())}, mapInArrow=lambda run, _: run)
    base.select = lambda *_: base
    nodes = spark.createDataFrame([(near_copies._node(near_copies._words(t)),) for t in texts[::2]], "node long")
    wanted = SimpleNamespace(value=near_copies._filter(nodes, "node").value)
    wanted.value.bits()
    batches = [pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["id", "text"])]
    for run, given, column in ((near_copies._fingerprinted(base, (24, 5)), batches, "node"), (near_copies._sets(base, wanted), [b.select(["text"]) for b in batches], "node")):
        tracemalloc.start()
        rows = sum(sum(1 for _ in b.column(column)) for b in run(iter(given)))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert rows in (3000, 1500) and peak < 25


def test_steps_write_no_more_files_than_their_rows_take(spark, tmp_path):
    """However many shuffle partitions there are; before, each step wrote as many files."""
    context, parts = spark.sparkContext, {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in parts}
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"last{i % 15}"])) for i in range(30)], "doc_id long, text string")
    folder = context.getCheckpointDir()
    try:
        context.setCheckpointDir(str(tmp_path))
        for k, v in parts.items():
            spark.conf.set(k, v)
        assert [r.doc_id for r in near_copies.keep_first(docs).collect()] == [0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        if folder:
            context.setCheckpointDir(folder.removeprefix("file:"))
    assert sum(1 for _ in tmp_path.rglob("part-*")) < 200
