"""I-Match document fingerprints over randomised lexicon subsets.

A first pass counts in how many documents each term occurs. The lexicon keeps
the terms whose inverse document frequency lies in a band. Its lower end of
document frequency is a share of the documents, so the lexicon has at most
``mean distinct terms of a document / share`` terms at any size of corpus, and
may be broadcast.

A fingerprint hashes several random subsets of the lexicon: the document's terms
in a subset, distinct and sorted, are hashed. Subsets come in levels; one of level
L keeps a term with chance 2^-L. A document uses the two levels in which a subset
holds about one of its terms or fewer, 16 subsets each: larger subsets change with
nearly every edit, smaller ones are mostly empty. The likeness of two fingerprints
is the share of equal hashes among the subsets, of levels that both use, in which
either has a term.

A document none of whose subsets holds a term is fingerprinted by its whole text.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut_lineage

#: Natural logarithms of documents / document frequency.
IDF_BAND = (math.log(5), math.log(2000))
#: Subsets of a level, and levels of a document.
SUBSETS, LEVELS = 16, 2
EMPTY = "-" * 8
WHOLE_TEXT = "ff"
#: The lexicon is sent to every task; the band bounds it by mean distinct terms times e to its upper end, and this checks it.
MOST_TERMS = 4_000_000
TERM = re.compile(r"[^\W_]+")
#: Scripts without spaces: their runs count by pairs of characters as well.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
FLUSH = 200_000
LAST = (1 << 63) - 1
#: Characters of a text that order rows of equal ids between buckets.
PREFIX = 64


def terms(text: str) -> set[str]:
    found = set(TERM.findall(text.lower()))
    if not text.isascii() and UNSPACED.search(text):
        for t in [t for t in found if UNSPACED.search(t)]:
            found.update(t[i : i + 2] for i in range(len(t) - 1))
    return found


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) over all rows; counts are summed within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(terms(text))
                if len(counts) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "df"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "df"])

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND, text_col: str = "text") -> DataFrame:
    """Terms of the band; ``docs`` counts with all its rows."""
    n = docs.count()
    return document_frequencies(docs, text_col).where(F.col("df").between(n * math.exp(-band[1]), n * math.exp(-band[0]))).select("term")


class Fingerprinter:
    """Texts to fingerprints: the first level as two hexadecimal digits, then the hashes of its subsets and of the next level's."""

    def __init__(self, kept: set[str]):
        self.kept, self.known = kept, {}

    def depths(self, term: str) -> bytes:
        """The deepest level at which each of the subsets (even levels first) holds the term."""
        found = self.known.get(term)
        if found is None:
            draws = np.frombuffer(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=4 * SUBSETS).digest(), "<u2")
            found = self.known[term] = np.floor(16 - np.log2(draws + 1.0)).astype(np.uint8).tobytes()
        return found

    def __call__(self, text: str) -> str:
        mine = sorted(terms(text) & self.kept)
        if mine:
            depth = np.frombuffer(b"".join(map(self.depths, mine)), np.uint8).reshape(len(mine), 2, SUBSETS)
            first = len(mine).bit_length()
            members: list[list[str]] = [[] for _ in range(LEVELS * SUBSETS)]
            for k in range(LEVELS):
                for term, subset in zip(*np.nonzero(depth[:, (first + k) % 2] >= first + k), strict=True):
                    members[k * SUBSETS + subset].append(mine[term])
            if any(members):
                hashed = [f"{xxhash.xxh32_intdigest(' '.join(m).encode('utf-8', 'surrogatepass'), i % SUBSETS):08x}" if m else EMPTY for i, m in enumerate(members)]
                return f"{first:02x}" + "".join(hashed)
        return WHOLE_TEXT + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _levels(fingerprint: str) -> dict[int, list[str]]:
    first, width = int(fingerprint[:2], 16), 8 * SUBSETS
    parts = [fingerprint[2 + k * width : 2 + (k + 1) * width] for k in range(LEVELS)]
    return {first + k: [p[i : i + 8] for i in range(0, width, 8)] for k, p in enumerate(parts)}


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if WHOLE_TEXT in (a[:2], b[:2]):
        return 0.0
    x, y = _levels(a), _levels(b)
    either = [p == q for level in x.keys() & y.keys() for p, q in zip(x[level], y[level], strict=True) if p != EMPTY or q != EMPTY]
    return sum(either) / len(either) if either else 0.0


def kept_terms(docs: DataFrame, band: tuple[float, float], text_col: str = "text") -> set[str]:
    """The lexicon, for the tasks; an error if it exceeds ``MOST_TERMS``, where the band should be narrower."""
    terms_kept = cut_lineage(lexicon(docs, band, text_col))
    if (n := terms_kept.count()) > MOST_TERMS:
        raise ValueError(f"the lexicon has {n} terms, more than {MOST_TERMS}; choose a band with a smaller upper end")
    return {r.term for r in terms_kept.toLocalIterator()}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """``id_col`` and fingerprint of every row.

    Null text counts as empty; null ids stay null; repeated rows give repeated
    results and count as documents of their own; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    kept = docs.sparkSession.sparkContext.broadcast(kept_terms(docs, band, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprinter(kept.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "fingerprint"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def in_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, tail, id, doc_id, text), partitioned by bucket and sorted in it.

    Buckets are ranges of ids, and of the heads of texts among rows of one id; as
    many as there are shuffle partitions, whatever the number of rows. The first
    document of each bucket is also sent, as a tail, to the bucket before it (the
    first of all to the last), so that every row finds the next document in its
    own partition. Rows are read in order there, one at a time.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    head = F.substring("text", 1, PREFIX)
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = base.select("id", head.alias("head")).repartitionByRange(buckets, "id", "head")
    # One row for each bucket: its first key.
    firsts = sorted(tuple(r.m) for r in ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("id", "head")).alias("m")).collect())

    def targets(ids: pd.Series, heads: pd.Series) -> pd.Series:
        out = []
        for key in zip(ids.tolist(), heads.tolist(), strict=True):
            b = bisect.bisect_right(firsts, key) - 1
            out.append([2 * b] + ([2 * ((b or len(firsts)) - 1) + 1] if firsts[b] == key else []))
        return pd.Series(out)

    sent = base.withColumn("t", F.explode(F.pandas_udf(targets, "array<int>")("id", head)))
    keyed = sent.select(F.shiftright("t", 1).alias("bucket"), (F.col("t") % 2).alias("tail"), "id", "doc_id", "text")
    return keyed.repartition("bucket").sortWithinPartitions("bucket", "tail", "id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half] if half else text


def imatch_report(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the next document.

    The next document follows by doc_id, rows of equal ids by text, null ids
    last; the first follows the last. Null text counts as empty; a text of fewer
    than two characters stays as it is. Repeated rows are documents of their own;
    an empty table gives an empty result; other columns are ignored.
    """
    # A term's share of the documents is bounded from below, so the lexicon's size is bounded.
    kept = docs.sparkSession.sparkContext.broadcast(kept_terms(docs, band))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprinter(kept.value)
        bucket = doc = text = mine = None
        closed = True  # the bucket's last document has met its tail
        for batch in batches:
            out = []
            for b, tail, d, t in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if b != bucket:
                    bucket, closed, text = b, False, None
                if closed:
                    continue  # another row of the tail's id
                print_ = of(t)
                if text is not None:
                    e = edited(text, t)
                    changed = mine if e == text else of(e)
                    digest = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((doc, len(text), digest, mine, changed, likeness(mine, changed), likeness(mine, print_)))
                doc, text, mine, closed = d, t, print_, bool(tail)
            kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return in_order(docs).mapInArrow(run, SCHEMA)
