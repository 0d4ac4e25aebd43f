"""Document quality by co-training two views.

The text view sees a document's words: shares of character kinds, repetition and
hashed word counts. The metadata view sees what a page's record says without
reading its words: language and source tags, length and line layout. Each view
has its own logistic regression. Over some rounds each labels the unlabelled
documents it is surest of for the other. At the end both are calibrated on
labelled documents kept aside, and a third regression combines them.

Only a bounded sample is used to fit (``labelled_rows`` labelled documents and
``pool_rows`` unlabelled ones, chosen by a hash of the id); every document is
scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_BUCKETS, LANG_BUCKETS, SOURCE_BUCKETS = 256, 16, 64
LABELLED_ROWS, POOL_ROWS, ROUNDS = 10_000, 10_000, 3
#: A view passes on what it gives at least this probability for either class, at most this share of the pool a round.
CONFIDENT, SHARE = 0.97, 0.1
THRESHOLD = 0.5

KINDS_OF_BYTES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"#$%&*@^~+=<>", b"|\\/_[]{}", bytes(range(128, 256)))
TEXT_WIDTH = 6 + len(KINDS_OF_BYTES) + WORD_BUCKETS
META_WIDTH = 4 + LANG_BUCKETS + SOURCE_BUCKETS


def text_features(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, w, distinct = len(raw), len(words), set(words)
    out = np.zeros(TEXT_WIDTH)
    if not w:
        return out
    letters = sum(map(len, words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    out[:6] = 1.0, np.log1p(w), letters / w, len(distinct) / w, len(distinct) / np.sqrt(w), same / w
    at = 6
    for kind in KINDS_OF_BYTES:
        out[at] = (n - len(raw.translate(None, kind))) / letters
        at += 1
    counts = np.bincount(np.fromiter((zlib.crc32(x.lower()) % WORD_BUCKETS for x in distinct), np.int64, len(distinct)), minlength=WORD_BUCKETS)
    out[at:] = np.sqrt(counts / len(distinct))
    return out


def meta_features(text: str, lang: str | None, source: str | None) -> np.ndarray:
    out = np.zeros(META_WIDTH)
    lines = text.count("\n") + 1
    out[:4] = np.log1p(len(text)), np.log1p(lines), np.log1p(len(text) / lines), len(text) == 0
    for at, buckets, tag in ((4, LANG_BUCKETS, lang), (4 + LANG_BUCKETS, SOURCE_BUCKETS, source)):
        out[at + (0 if tag is None else 1 + zlib.crc32(tag.encode()) % (buckets - 1))] = 1.0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Logistic:
    """Logistic regression with standardised inputs and a ridge penalty, fitted by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = sigmoid(z @ w)
            slope = z.T @ (y - p) - penalty * w
            bend = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(bend, slope)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -35, 35)


@dataclass
class CoTrained:
    """Two views, their calibrations and the combination. ``rate`` alone if there was nothing to learn."""

    rate: float
    views: tuple[Logistic, Logistic] | None = None
    calibrations: tuple[Logistic, Logistic] | None = None
    combined: Logistic | None = None

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: combined score, calibrated text view, calibrated metadata view."""
        if self.views is None:
            return np.full((len(text), 3), self.rate)
        logits = np.column_stack([c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (text, meta), strict=True)])
        return sigmoid(np.column_stack([self.combined.logit(logits), logits]))


def co_train(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> CoTrained:
    """``x`` and ``pool``: text and metadata features of labelled and unlabelled documents; ``y``: 0 or 1."""
    rate = float(y.mean()) if len(y) else 1.0
    aside = np.arange(len(y)) % 3 == 2  # for calibration; rows come in hash order
    if any(len(np.unique(y[part])) < 2 for part in (aside, ~aside)):
        return CoTrained(rate)
    own = [(x[v][~aside], y[~aside]) for v in (0, 1)]
    views = [Logistic.fit(*own[v]) for v in (0, 1)]
    open_ = np.ones(len(pool[0]), bool)
    for _ in range(rounds):
        passed = []
        for v in (0, 1):
            p = sigmoid(views[v].logit(pool[v]))
            most = max(1, int(SHARE * len(p)))
            take = []
            for label, sure, share in ((1.0, p, rate), (0.0, 1 - p, 1 - rate)):
                good = np.flatnonzero(open_ & (sure >= CONFIDENT))
                best = good[np.argsort(-sure[good], kind="stable")][: int(most * share)]
                take += [(best, np.full(len(best), label))]
            passed.append((np.concatenate([t[0] for t in take]), np.concatenate([t[1] for t in take])))
        if not any(len(p[0]) for p in passed):
            break
        for v, (rows, labels) in ((1, passed[0]), (0, passed[1])):  # each view learns from the other's labels
            own[v] = np.concatenate([own[v][0], pool[v][rows]]), np.concatenate([own[v][1], labels])
            views[v] = Logistic.fit(*own[v])
        open_[np.concatenate([passed[0][0], passed[1][0]])] = False
    raw = [views[v].logit(x[v][aside])[:, None] for v in (0, 1)]
    calibrations = [Logistic.fit(r, y[aside]) for r in raw]
    both = np.column_stack([c.logit(r) for c, r in zip(calibrations, raw, strict=True)])
    return CoTrained(rate, tuple(views), tuple(calibrations), Logistic.fit(both, y[aside]))


def _features(docs: DataFrame, id_col: str, extra: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang, source = (batch.column(k).to_pylist() for k in range(3))
            a = [text_features(t).astype(np.float32) for t in text]
            b = [meta_features(*r).astype(np.float32) for r in zip(text, lang, source, strict=True)]
            rest = [batch.column(3 + k) for k in range(len(extra))]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.list_(pa.float32())), pa.array(b, pa.list_(pa.float32())), *rest], names=["a", "b", *extra])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.select("text", "lang", "source", *extra).mapInArrow(run, f"a array<float>, b array<float>, {kinds}")


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS, rounds: int = ROUNDS
) -> CoTrained:
    """Co-train on a sample of ``docs`` of a stated size; several labels of one document count by their mean.

    About ``labelled_rows`` labelled and ``pool_rows`` other rows reach the
    driver, as features of fixed width, whatever the number of rows and however
    often an id is repeated. Labels with a null id or value don't count; null
    text counts as empty; rows with a null id may be in the pool. Without labels
    of both classes the model is the share of good labels, 1 if there are none.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    sampled = one.orderBy(F.xxhash64("id"), "id").limit(labelled_rows)  # at most labelled_rows rows, so it may be broadcast
    n = docs.count()
    share = min(1.0, pool_rows / max(n, 1))
    below = lambda what, part: F.pmod(what, F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))
    chosen = F.when(F.col("y").isNotNull(), "labelled").when(below(F.xxhash64("id", F.lit("pool")), share), "pool")
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    labelled = lambda rows: rows.join(F.broadcast(sampled), "id", "left").withColumn("chosen", chosen).where("chosen is not null")
    met = {r.chosen: r["count"] for r in labelled(named.select("id")).groupBy("chosen").count().collect()}
    taken = labelled(named).withColumn("h", F.xxhash64("id"))
    if met.get("labelled", 0) > labelled_rows or met.get("pool", 0) > 2 * pool_rows:  # rows of repeated ids are thinned out one by one
        part = F.when(F.col("chosen") == "pool", F.lit(min(1.0, pool_rows / max(1, met.get("pool", 0))))).otherwise(F.lit(min(1.0, labelled_rows / max(1, met.get("labelled", 0)))))
        row = F.xxhash64(F.monotonically_increasing_id(), F.lit("row"))
        taken = taken.withColumn("h", row).where(F.pmod("h", F.lit(1 << 30)) < part * F.lit(1 << 30))
    got = _features(taken, id_col, ["y", "h"]).toArrow()
    h = got.column("h").to_numpy()
    sort = np.argsort(h, kind="stable")
    y = got.column("y").to_numpy(zero_copy_only=False)[sort]
    # As they lie in memory: a list of Python floats would take eight times that.
    x = [got.column(c).combine_chunks().flatten().to_numpy().reshape(-1, w)[sort].astype(np.float64) for c, w in (("a", TEXT_WIDTH), ("b", META_WIDTH))]
    del got
    known = ~np.isnan(y)
    return co_train((x[0][known], x[1][known]), y[known], (x[0][~known], x[1][~known]), rounds)


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, score, text_score, meta_score of every row; null text counts as empty, null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang, source = (batch.column(1 + k).to_pylist() for k in range(3))
            for at in range(0, len(text), 1024):
                part = slice(at, at + 1024)
                a = np.stack([text_features(t) for t in text[part]])
                b = np.stack([meta_features(*r) for r in zip(text[part], lang[part], source[part], strict=True)])
                made = model.score(a, b)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 1024], *map(pa.array, made.T)], names=["id", "score", "text_score", "meta_score"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string"), F.col("source").cast("string"))
    return base.mapInArrow(run, "id long, score double, text_score double, meta_score double").withColumnRenamed("id", id_col)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """Score and decision for every document.

    Returns doc_id, score, text_score, meta_score and keep (score at least
    ``threshold``). Null text counts as empty, null language and source have
    buckets of their own, null ids stay null. Without labels of both classes
    every score is the share of good labels, or 1 if there are none. Repeated
    rows get equal results; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    model = fit(docs, labels, **how)
    return score(docs, model).withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, columns unchanged, whatever their names.

    Null text is scored as empty and stays null; rows with null ids are scored
    like any other; repeated rows stay or go together; an empty table gives an
    empty result. ``fit`` says what happens without labels.
    """
    model = fit(docs, labels, **how)
    names = docs.columns
    place = {c: names.index(c) for c in ("text", "lang", "source")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                text, lang, source = (part.column(place[c]).to_pylist() for c in ("text", "lang", "source"))
                text = [t or "" for t in text]
                a = np.stack([text_features(t) for t in text])
                b = np.stack([meta_features(*r) for r in zip(text, lang, source, strict=True)])
                yield part.filter(pa.array(model.score(a, b)[:, 0] >= threshold))

    return docs.mapInArrow(run, docs.schema)
