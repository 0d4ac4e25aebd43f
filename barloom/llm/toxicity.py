"""Toxicity of texts whose words may be disguised, by a noisy channel.

A disguised word went through a channel that swaps letters for look-alikes
("m0r0n"), puts separators between letters ("s c u m", "s.c.u.m") and repeats
letters ("loooser"). For such a stretch there is a lattice: each character may
stand for itself, for the letters it looks like, for a break between words or, as
a separator or a repetition, for nothing. The Viterbi path through the lattice
under a character trigram model, counted over all documents, restores the text.
A stretch without such characters has one path only, so it is left as it is.

The restored words are scored. How much a word, or its first four or five letters,
tells of toxic documents is learned from labelled ones; a logistic regression over
a document's most telling words gives the score.

Bounded: ``labelled_rows`` labelled documents of each class, chosen by a hash of the
id, are learned from. The character model is counted over all documents, and every
document is scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import language
from barloom.llm.common import cut_lineage, text_or_empty
from barloom.llm.quality import Logistic, sigmoid

LABELLED_ROWS = 10_000
FOLDS = 5
#: Counts below about this many documents tell nothing; less than LEAST_WEIGHT isn't kept.
SHRINK, LEAST_WEIGHT = 2.0, 1.0
BUCKETS = 1 << 22
HELD = 500_000
BATCH_CHARS = 1 << 20

#: What characters may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = frozenset(" .-_*~\t")
#: Logarithms of the channel: a letter as itself, a repetition left out, a look-alike as a letter, as a break, a separator as nothing, as a break.
PLAIN, REPEATED, ALIKE, LITERAL, JOINED, APART = (math.log(p) for p in (0.9, 0.3, 0.4, 0.02, 0.3, 0.3))

_LOOK = "[" + re.escape("".join(LOOKS)) + "]"
#: A letter beside a look-alike, a letter three times, or separators between letters.
DISGUISED = re.compile(rf"[^\W\d_]{_LOOK}|{_LOOK}[^\W\d_]|([^\W\d_])\1\1|[^\W\d_][.\-_*~]+[^\W\d_]")
#: Single characters one after another.
SPACED = re.compile(rf"(?<!\S)(?:[^\W\d_]|{_LOOK})(?:[ \t]+(?:[^\W\d_]|{_LOOK})){{2,}}(?!\S)")
WORD = re.compile(r"[^\W\d_]+")
BEFORE, AFTER = ".,;:!?\"'()[]{}<>*-_~", ".,;:!?\"'()[]{}<>*$@|+-_~"


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each trigram of letter slots occurs in all texts; 64³ numbers whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, size = np.zeros(language.GRAMS, np.int64), [], 0

        def count() -> None:
            sums[:] += np.bincount(language.trigrams(" ".join(held)), minlength=language.GRAMS)
            held.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(text)
                size += len(text)
                if size >= BATCH_CHARS:
                    count()
                    size = 0
        count()
        grams = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(sums[grams])], names=["gram", "n"])

    rows = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(language.GRAMS, np.int64)
    for r in rows:
        counts[r.gram] = r.n
    return counts


@dataclass
class Letters:
    """Character model: log probabilities of a slot after two others, with shorter contexts mixed in."""

    logs: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, mix: float = 5.0) -> Letters:
        n3 = counts.reshape((language.SLOTS,) * 3).astype(float)
        n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
        p1 = (n1 + 0.1) / (n1 + 0.1).sum()
        p2 = (n2 + mix * p1) / (n2.sum(axis=1, keepdims=True) + mix)
        p3 = (n3 + mix * p2[None]) / (n3.sum(axis=2, keepdims=True) + mix)
        return cls(np.log(p3).astype(np.float32))


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for, "" for nothing and " " for a break, with the channel's logarithm."""
    made = []
    for i, c in enumerate(span):
        if c in LOOKS:
            ways = [(x, ALIKE) for x in LOOKS[c]] + [(" ", LITERAL)]
        elif c in SEPARATORS:
            ways = [("", JOINED), (" ", APART)]
        elif c.isalpha():
            ways = [(c, PLAIN)]
        else:
            ways = [(" ", PLAIN)]
        if i and c == span[i - 1] and ways[0][0] not in ("", " "):
            ways.append(("", REPEATED))
        made.append(ways)
    return made


def restore(span: str, letters: Letters) -> str:
    """The likeliest text behind a disguised stretch in lower case, words between single blanks."""
    table, logs = language.slot_table(), letters.logs
    slot = lambda c: 0 if c == " " else int(table[ord(c)]) if ord(c) < len(table) else 27 + ord(c) % (language.SLOTS - 27)
    # A state is the last two slots; its value the score and the letters so far, as nested pairs.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ways in [*lattice(span), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for letter, cost in ways:
                if letter == "" or letter == " " and b == 0:
                    state, total, way = (a, b), score + cost, path
                else:
                    s = slot(letter)
                    state, total, way = (b, s), score + cost + float(logs[a, b, s]), (path, letter)
                old = after.get(state)
                if old is None or total > old[0]:
                    after[state] = total, way
        states = after
    _, path = max(states.values(), key=lambda v: v[0])
    found = []
    while path is not None:
        path, letter = path
        found.append(letter)
    return "".join(reversed(found)).strip()


def words_of(token: str, letters: Letters) -> list[str]:
    """Words of a token in lower case between blanks, restored if it is disguised; what it says as it stands comes too."""
    words = WORD.findall(token)
    core = token.lstrip(BEFORE).rstrip(AFTER)
    if DISGUISED.search(core):
        words += restore(core, letters).split()
    return words


def stretches(text: str) -> tuple[Counter[str], list[str]]:
    """Tokens of a text in lower case with their counts, and its stretches of single characters."""
    low = text.lower()
    return Counter(low.split()), [s for s in SPACED.findall(low) if len(set(s)) > 2]


def features_of(word: str) -> list[int]:
    """Buckets of a word and of its first four and five letters."""
    made = [word, *(f"{word[:k]}-" for k in (4, 5) if len(word) > k)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in made]


DOC_WIDTH = 6


@dataclass
class Model:
    letters: Letters
    weights: dict[int, float]
    final: Logistic | None
    shift: float
    prior: float
    #: Of tokens met before; emptied when it is full.
    known: dict[str, float] = field(default_factory=dict)

    def weight(self, token: str, spaced: bool = False) -> float:
        """How much the most telling word of a token tells."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= HELD:
                self.known.clear()
            words = restore(token, self.letters).split() if spaced else words_of(token, self.letters)
            got = max((self.weights.get(f, 0.0) for w in words for f in features_of(w)), default=0.0)
            self.known[token] = got
        return got

    def document(self, text: str) -> list[float]:
        """Three highest weights, how many words tell and their share, and how many words there are."""
        tokens, spaced = stretches(text)
        found = [(w, n) for t, n in tokens.items() if (w := self.weight(t)) > 0]
        found += [(w, 1) for s in spaced if (w := self.weight(s, True)) > 0]
        top = sorted((w for w, _ in found), reverse=True)[:3]
        n, told = sum(tokens.values()), sum(n for _, n in found)
        return [*top, *[0.0] * (3 - len(top)), math.log1p(told), told / max(n, 1), math.log1p(n)]

    def score(self, rows: list[list[float]]) -> np.ndarray:
        if self.final is None:
            return np.full(len(rows), self.prior)
        return sigmoid(self.final.logit(np.array(rows).reshape(-1, DOC_WIDTH)) + self.shift)


def crc(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def is_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves no remainder by 5; a null id isn't held out."""
    return F.coalesce(crc(id_col) == 0, F.lit(False))


def _weights(sample: DataFrame, letters: Letters, n: tuple[int, int]) -> dict[int, np.ndarray]:
    """For each telling bucket its weight, from all folds and from all but each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[int] = Counter()
        seen: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["key", "n"])
            held.clear()
            return made

        for batch in batches:
            for toxic, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, spaced = stretches(text)
                met: set[int] = set()
                for t in tokens:
                    if t not in seen:
                        if len(seen) >= HELD:
                            seen.clear()
                        seen[t] = [f for w in words_of(t, letters) for f in features_of(w)]
                    met.update(seen[t])
                met.update(f for s in spaced for w in restore(s, letters).split() for f in features_of(w))
                held.update((f * FOLDS + fold) * 2 + toxic for f in met)
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    counts = sample.select("toxic", "fold", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    bucket, rest = F.floor(F.col("key") / (2 * FOLDS)), F.pmod("key", F.lit(2 * FOLDS))
    sums = [F.sum(F.when(rest == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(2 * FOLDS)]
    toxic = sum((F.col(f"c{2 * f + 1}") for f in range(FOLDS)), F.lit(0))
    # The weight of a bucket in fewer toxic documents stays below the least, whatever the folds.
    rows = counts.groupBy(bucket.alias("bucket")).agg(*sums).where(toxic >= math.exp(LEAST_WEIGHT) * SHRINK - SHRINK).collect()
    made = {}
    for r in rows:
        c = np.array(r[1:], float).reshape(FOLDS, 2)
        c = np.vstack([c.sum(axis=0), c.sum(axis=0) - c])
        w = np.log((c[:, 1] + SHRINK) / (c[:, 0] * n[1] / n[0] + SHRINK))
        if w.max() >= LEAST_WEIGHT:
            made[r.bucket] = np.where(w >= LEAST_WEIGHT, w, 0.0)
    return made


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Learn from the labelled documents that aren't held out; ``labelled_rows`` of each class at most.

    Labels other than 0 and 1, and null ids, teach nothing; an id with both labels counts
    as toxic; rows of an id count by that one that tells most. Without labels of both
    classes every score is the share of toxic labels, 0 if there are none.
    """
    letters = Letters.of(trigram_counts(docs))
    taught = labels.where("doc_id is not null and toxic in (0, 1)").where(~is_held_out()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    taught = cut_lineage(taught.select("id", "toxic", crc("id").cast("int").alias("fold")))
    there = {r.toxic: r["count"] for r in taught.groupBy("toxic").count().collect()}
    whole = there.get(0, 0), there.get(1, 0)
    none = Model(letters, {}, None, 0.0, whole[1] / max(sum(whole), 1))
    if not all(whole):
        return none
    some = [taught.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(labelled_rows) for k in (0, 1)]
    chosen = F.broadcast(cut_lineage(some[0].unionByName(some[1])))  # at most 2 * labelled_rows rows
    sample = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text")).join(chosen, "id").select("id", "toxic", "fold", "text")
    sample = cut_lineage(sample)
    n = tuple(sample.where(F.col("toxic") == k).count() for k in (0, 1))
    if not all(n):
        return none
    by_fold = _weights(sample, letters, n)
    models = [Model(letters, {b: float(w[1 + f]) for b, w in by_fold.items() if w[1 + f]}, None, 0.0, 0.0) for f in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [models[fold].document(text) for fold, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["id", "toxic", "x"])

    seen = sample.mapInArrow(run, f"id {sample.schema['id'].dataType.simpleString()}, toxic int, x array<double>").groupBy("id").agg(F.max(F.struct("x", "toxic")).alias("r")).select("r.*").collect()
    y = np.array([r.toxic for r in seen], float)
    final = Logistic.fit(np.array([r.x for r in seen]), y)
    # Classes were sampled apart; their real shares are put back.
    shift = math.log(whole[1] / whole[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(letters, {b: float(w[0]) for b, w in by_fold.items() if w[0]}, final, shift, 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out and score of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.score([model.document(t) for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.float64())], names=["id", "held_out", "score"])

    base = docs.select(F.col(id_col).alias("id"), is_held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, held_out boolean, score double").withColumnRenamed("id", id_col)


def toxicity_report(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of every row.

    A score sees the text alone. Null text counts as empty and is scored like any
    text; a null id isn't held out; repeated rows get equal scores; an empty table gives
    an empty result; other columns are ignored, whatever their names. :func:`fit` says
    what happens without labels.
    """
    return score(docs, fit(docs, labels, **how)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
