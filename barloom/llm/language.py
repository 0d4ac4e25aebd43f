"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of a trigram binds
those of its letters, each rotated by its place: ``r2(a) * r1(b) * c``. A text is
the bundle (sum) of its trigrams' vectors, a language the bundle of its texts,
and a text is compared with the languages by cosine.

Both bundles are linear in trigram counts. So learning only counts trigrams by
language, which Spark sums before anything is shuffled, and a text's vector is a
product of its counts with the vectors of the trigrams at hand. Letter vectors
come from a seed; nothing of the model is larger than languages x dimensions.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut_lineage

DIMENSIONS = 1024
SEED = 7
#: Slot 0 is everything that isn't a letter, 1..26 are a..z, the rest are shared by other letters.
SLOTS = 64
GRAMS = SLOTS**3
BATCH_CHARS = 1 << 20
UNKNOWN = "und"
#: Profiles are sent to every task; more languages than this are an error.
MOST_LANGUAGES = 5000


@functools.cache
def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SLOTS, dimensions))


@functools.cache
def slot_table() -> np.ndarray:
    """Slot of each code point below 0x3000; letters above are slotted by their number."""
    made = np.zeros(0x3000, np.uint8)
    for cp in range(0x3000):
        c = chr(cp).lower()[:1]
        if c.isalpha():
            made[cp] = ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (SLOTS - 27)
    return made


def slots(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = slot_table()
    low = points < len(table)
    made = table[np.where(low, points, 0)]
    if not low.all():
        high = np.flatnonzero(~low)
        made[high] = [27 + p % (SLOTS - 27) if chr(p).isalpha() else 0 for p in points[high].tolist()]
    return made


def trigrams(text: str) -> np.ndarray:
    """Trigram numbers of a text between blanks at both ends, runs of non-letters as one blank."""
    s = slots(text)
    s = np.concatenate([[0], s, [0]]).astype(np.int64)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    if len(s) < 3:
        return np.zeros(0, np.int64)
    made = (s[:-2] * SLOTS + s[1:-1]) * SLOTS + s[2:]
    return made


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    letters = letter_vectors(dimensions)
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return first[grams // (SLOTS * SLOTS)] * second[grams // SLOTS % SLOTS] * letters[grams % SLOTS]


def bundle(texts: list[str], dimensions: int) -> np.ndarray:
    """One vector for each text, by counts times trigram vectors in blocks of columns."""
    parts = [trigrams(t) for t in texts]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    out = np.zeros((len(texts), dimensions), np.float32)
    if not len(doc):
        return out
    pairs, counts = np.unique(doc * GRAMS + np.concatenate(parts), return_counts=True)
    rows, grams = pairs // GRAMS, pairs % GRAMS
    distinct, column = np.unique(grams, return_inverse=True)
    for at in range(0, len(distinct), 4096):
        mine = (column >= at) & (column < at + 4096)
        width = min(4096, len(distinct) - at)
        dense = np.zeros((len(texts), width), np.float32)
        dense[rows[mine], column[mine] - at] = counts[mine]
        out += dense @ gram_vectors(distinct[at : at + width], dimensions).astype(np.float32)
    return out


@dataclass
class Profiles:
    """Unit vectors of the languages; ``centre`` is what all of them share and is taken off both sides."""

    names: list[str]
    centre: np.ndarray
    vectors: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        v = bundle(texts, self.vectors.shape[1])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        v -= self.centre
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        cosines = v @ self.vectors.T
        best = cosines.argmax(axis=1)
        return [self.names[i] for i in best], np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(float)


def _gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) summed within each task; docs has lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                grams = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n[grams])], names=["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    if len(sums) >= 32:
                        yield from flush()
                    sums[lang] = np.zeros(GRAMS, np.int64)
                grams = trigrams(text)
                if len(grams) > 20_000:
                    sums[lang] += np.bincount(grams, minlength=GRAMS)
                else:
                    np.add.at(sums[lang], grams, 1)
        yield from flush()

    return docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> Profiles:
    """Profiles of the languages in ``lang``, from all rows of ``docs`` with a language and text.

    Rows without either teach nothing; repeated rows count as often as they
    occur. A language without a trigram, and an empty table, give no profile.
    """
    counts = cut_lineage(_gram_counts(docs.where("lang is not null and text is not null").select("lang", "text")))

    def bundle_counts(group: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(dimensions)
        for at in range(0, len(group), 4096):
            part = group.iloc[at : at + 4096]
            v += part["n"].to_numpy(np.float64) @ gram_vectors(part["gram"].to_numpy(), dimensions)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "v": [v]})

    # One row for each language, of fixed width.
    if counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = sorted(counts.groupBy("lang").applyInPandas(bundle_counts, "lang string, v array<double>").collect(), key=lambda r: r.lang)
    v = np.array([r.v for r in rows], np.float32).reshape(-1, dimensions)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    centre = v.mean(axis=0) if len(rows) > 1 else np.zeros(dimensions, np.float32)
    v = v - centre
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return Profiles([r.lang for r in rows], centre.astype(np.float32), v.astype(np.float32))


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """``id_col``, lang_pred and score of every row; ``carry`` are further columns to keep.

    Null text, and text without a letter, is ``und`` with score 0.
    """
    extra = len(carry or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            named, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            todo: list[int] = []
            size = 0

            def flush() -> None:
                got, s = profiles.predict([texts[i] for i in todo])
                for k, i in enumerate(todo):
                    named[i], scores[i] = got[k], s[k]

            for i, t in enumerate(texts):
                if t is not None and has_letter(t):
                    todo.append(i)
                    size += len(t)
                if size >= BATCH_CHARS or len(todo) >= 512:
                    flush()
                    todo, size = [], 0
            if todo:
                flush()
            rest = [batch.column(2 + k) for k in range(extra)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, pa.array(named, pa.string()), pa.array(scores)], names=["id", *batch.schema.names[2:], "lang_pred", "score"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(carry or []))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text")
    return base.mapInArrow(run, f"{kinds}, lang_pred string, score double").withColumnRenamed("id", id_col)


def is_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out, predict all.

    Returns doc_id, held_out, lang_pred, score. Only text and non-null languages
    of the first are learned from; a prediction sees the text alone. A null id
    isn't held out. Repeated rows count as often as they occur and get equal
    results; an empty table gives an empty result; other columns are ignored.
    """
    profiles = learn(docs.where(~is_held_out()).select("text", "lang"))
    return predict(docs, profiles, carry=[is_held_out().alias("held_out")])
