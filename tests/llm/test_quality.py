import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from barloom.llm import quality


def corpus(n=400):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("th", "er", "on", "in", "at") for b in ("e", "an", "ing", "ed", "or")]
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = " ".join(rng.choice(words, int(rng.integers(20, 200))))
        if not good:
            text = (" | ".join(text.split()), text.upper().replace(" ", "!! "), "buy now " * 40)[i // 4 % 3]
        docs.append((i, text, ("en", "de")[i % 2], f"src{i % 5 + 10 * (not good and i % 3 > 0)}", len(text), "x"))
        labels.append((i, int(good), 0))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, l = frames(spark, docs, labels[:200] + [labels[3], (None, 0, 0), (5, None, 0)])
    got = {r.doc_id: r for r in quality.quality_report(d, l).collect()}
    truth = {i: q for i, q, _ in labels}
    assert len(got) == len(docs)
    right = sum(got[i].keep == bool(truth[i]) for i in range(200, 400))
    assert right >= 190 and all(0 <= r.score <= 1 for r in got.values())


def test_rounds_bring_pseudo_labels():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000).astype(float)
    a = y[:, None] * 2 + rng.normal(size=(3000, 5))
    b = y[:, None] * 2 + rng.normal(size=(3000, 4))
    few = slice(0, 60)
    pool = (a[60:1500], b[60:1500])
    alone = quality.co_train((a[few], b[few]), y[few], pool, rounds=0)
    taught = quality.co_train((a[few], b[few]), y[few], pool, rounds=3)
    accuracy = lambda m: ((m.score(a[1500:], b[1500:])[:, 0] >= 0.5) == y[1500:]).mean()
    assert accuracy(taught) >= accuracy(alone) - 0.02 and accuracy(taught) > 0.9
    assert not np.allclose(alone.views[0].weights, taught.views[0].weights)


def test_nulls_keep_and_columns(spark):
    docs, labels = corpus(120)
    d, l = frames(spark, docs + [(None, None, None, None, None, None), (7, "", None, None, 0, None), docs[3]], labels)
    rows = quality.quality_report(d, l).collect()
    assert len(rows) == 123 and all(r.score is not None for r in rows)
    kept = quality.keep_good(d, l)
    assert kept.columns == d.columns and kept.count() == sum(r.keep for r in rows)


def test_nothing_to_learn(spark):
    docs, labels = corpus(20)
    d, l = frames(spark, docs, [])
    assert {r.score for r in quality.quality_report(d, l).collect()} == {1.0}
    assert quality.quality_report(d.limit(0), l).count() == 0
    d, l = frames(spark, docs, [x for x in labels if x[1]])
    assert quality.quality_report(d, l).where(F.col("keep")).count() == 20


def plain_features(text, lang, source):
    """Both views of one document, value by value."""
    words = text.split()
    count = lambda chars: len([b for b in text.encode() if b in chars])
    view = [0.0] * (13 + 256)
    if words:
        letters = len("".join(words).encode())
        view[:6] = [1.0, np.log(1 + len(words)), letters / len(words), len(set(words)) / len(words), len(set(words)) / len(words) ** 0.5, sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / len(words)]
        kinds = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"#$%&*@^~+=<>", b"|\\/_[]{}", bytes(range(128, 256))]
        view[6:13] = [count(k) / letters for k in kinds]
        for w in set(words):
            view[13 + zlib.crc32(w.lower().encode()) % 256] += 1 / len(set(words))
        view[13:] = [v**0.5 for v in view[13:]]
    lines = len(text.split("\n"))
    meta = [np.log(1 + len(text)), np.log(1 + lines), np.log(1 + len(text) / lines), float(text == "")] + [0.0] * 80
    meta[4 + (0 if lang is None else 1 + zlib.crc32(lang.encode()) % 15)] = 1.0
    meta[20 + (0 if source is None else 1 + zlib.crc32(source.encode()) % 63)] = 1.0
    return np.float32(view).astype(float), np.float32(meta).astype(float)


def plain_logistic(x, y):
    """Ridge logistic regression over standardised inputs; returns a function to logits."""
    mean, scale = x.mean(0), np.where(x.std(0) < 1e-9, 1.0, x.std(0))
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.ones(z.shape[1] - 1), 1e-6]
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve(z.T @ np.diag(p * (1 - p) + 1e-6) @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step
        if abs(step).max() < 1e-6:
            break
    return lambda q: np.clip(np.c_[(q - mean) / scale, np.ones(len(q))] @ w, -35, 35)


def test_scores_against_a_plain_version(spark):
    docs, labels = corpus(240)
    docs = [(*d[:5], "x") for d in docs]
    labels = labels[:120]
    d, l = frames(spark, docs, labels)
    got = {r.doc_id: r.score for r in quality.quality_report(d, l).collect()}
    signed = lambda i: (xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42) + 2**63) % 2**64  # noqa: E731  as Spark orders them
    order = sorted(range(240), key=signed)
    both = {i: plain_features(*docs[i][1:4]) for i in order}
    truth = {i: float(q) for i, q, _ in labels}
    known, pool = [i for i in order if i in truth], [i for i in order if i not in truth]
    own = {v: [(i, truth[i]) for k, i in enumerate(known) if k % 3 != 2] for v in (0, 1)}
    fitted = lambda v: plain_logistic(np.array([both[i][v] for i, _ in own[v]]), np.array([y for _, y in own[v]]))
    views, rate = [fitted(0), fitted(1)], np.mean([truth[i] for i in known])
    left = list(pool)
    for _ in range(3):
        passed = []
        for v in (0, 1):
            p = {i: 1 / (1 + np.exp(-views[v](both[i][v][None])[0])) for i in left}
            good = sorted((i for i in left if p[i] >= 0.97), key=lambda i: -p[i])[: int(max(1, int(0.1 * len(pool))) * rate)]
            bad = sorted((i for i in left if 1 - p[i] >= 0.97), key=lambda i: -(1 - p[i]))[: int(max(1, int(0.1 * len(pool))) * (1 - rate))]
            passed.append([(i, 1.0) for i in good] + [(i, 0.0) for i in bad])
        if not any(passed):
            break
        for v in (0, 1):
            own[v] += passed[1 - v]
            views[v] = fitted(v)
        left = [i for i in left if i not in {j for p in passed for j, _ in p}]
    aside = [i for k, i in enumerate(known) if k % 3 == 2]
    y = np.array([truth[i] for i in aside])
    logits = lambda ids, v: views[v](np.array([both[i][v] for i in ids]))[:, None]
    calibrated = [plain_logistic(logits(aside, v), y) for v in (0, 1)]
    stacked = lambda ids: np.c_[calibrated[0](logits(ids, 0)), calibrated[1](logits(ids, 1))]
    final = 1 / (1 + np.exp(-plain_logistic(stacked(aside), y)(stacked(order))))
    assert max(abs(got[i] - s) for i, s in zip(order, final)) < 1e-3


def test_the_sample_is_bounded_by_rows(spark):
    """A third of the rows share one labelled id, another third one id without a label, yet the sample stays near its bound."""
    seen = []
    docs = spark.range(9000).selectExpr("case id % 3 when 0 then 1 when 1 then 777777 else id end doc_id", "concat('some words ', id) text", "'en' lang", "'s' source")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 400)], "doc_id long, quality int")
    co_train = quality.co_train
    try:
        quality.co_train = lambda x, y, pool, rounds: (seen.append((len(y), len(pool[0]))), co_train(x, y, pool, rounds))[1]
        quality.fit(docs, labels, labelled_rows=200, pool_rows=300)
    finally:
        quality.co_train = co_train
    assert 50 < seen[0][0] < 320 and seen[0][1] < 600


def test_very_long_text(spark):
    docs, labels = corpus(40)
    d, l = frames(spark, [*docs, (900, "word " * 400_000, "en", "s", 0, "x")], labels)
    assert quality.quality_report(d, l).where("doc_id = 900 and score is not null").count() == 1


def test_features_reach_the_driver_without_lists_of_floats(spark, monkeypatch):
    """The driver holds the sample as numbers, some 12 bytes each; before, each was a Python float in a list, 32 bytes and more."""
    import tracemalloc

    n = 3000
    docs = spark.createDataFrame([(i, f"some text {i}", "en", "s") for i in range(n)], "doc_id long, text string, lang string, source string").repartition(3)
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(0, n, 2)], "doc_id long, quality double")
    given = []
    monkeypatch.setattr(quality, "co_train", lambda x, y, pool, rounds: given.extend((x, y, pool)))
    tracemalloc.start()
    quality.fit(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x, y, pool = given
    assert len(y) == len(x[0]) == n // 2 and x[0].dtype == np.float64 and sum(map(len, (x[0], pool[0]))) == n
    assert peak < n * (quality.TEXT_WIDTH + quality.META_WIDTH) * 30
