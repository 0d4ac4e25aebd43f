"""Periodic runs of words, found octave by octave in overlapping tiles.

A run is a stretch of words with smallest period q that is at least max(6, 4 q)
words long and can't be extended. Its words equal those q further on over at least
3 q places; that stretch of equal places is what is looked for.

1. Every document is cut into tiles once per period octave [P, 2 P): an anchor each
   3 P words, the 3 P places before and after it and 2 P words more. The equal
   places of a run whose period lies in the octave hold an anchor. Tiles without a
   period that matches for some words beside the anchor are left out at once, so
   that common texts give no tile at all.
2. Tiles are solved each on its own, wherever Spark puts them: the Z-function of
   what follows the anchor says how far each period goes on, the Z-function of what
   precedes it, read backwards, how far it goes back.
3. The fragments are dealt by document and period, and those that touch are stitched.

A fragment whose first q words are a power of something shorter belongs to a run
of that shorter period, and is left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import shared_dir, text_or_empty

#: A run has at least LEAST words and POWER periods.
LEAST, POWER = 6, 4
#: Anchors of an octave lie REACH * P words apart.
REACH = POWER - 1
#: So many words beside an anchor are compared before a tile is made.
PROBE = 8
BATCH_WORDS = 1 << 19

CUT_SCHEMA = "rid long, doc_id {id}, n_words long, collapsed string, text string, octave int, anchor long, low long, words array<int>"


def split_words(text: str) -> list[bytes]:
    """Words between blanks and the controls 9 to 13."""
    return text.encode("utf-8", "surrogatepass").split()


def with_tail(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words of one document in ten repeat from some place on, by the crc32 of its id; a null id changes nothing."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def _matches_on(w: np.ndarray, at: np.ndarray, q: np.ndarray, step: int, most: int) -> np.ndarray:
    """Which pairs of place and period match at ``most`` places in a row, the place itself (or the one before) first."""
    alive = np.arange(len(at))
    for j in range(most):
        i = at[alive] + (j if step > 0 else -1 - j)
        ok = (i >= 0) & (i + q[alive] < len(w))
        i = np.where(ok, i, 0)
        alive = alive[ok & (w[i] == w[np.where(ok, i + q[alive], 0)])]
        if not len(alive):
            break
    return alive


def tile_places(w: np.ndarray) -> Iterator[tuple[int, int]]:
    """(octave, anchor) of the tiles that may hold a part of a run."""
    octave = 1
    while POWER * octave <= len(w) and len(w) >= LEAST:
        anchors = np.arange(0, len(w) - octave, REACH * octave)
        rows = max(1, BATCH_WORDS // octave)
        for at in range(0, len(anchors), rows):
            part = anchors[at : at + rows]
            reach = part[:, None] + np.arange(octave, min(2 * octave, len(w)))
            c, q = np.nonzero(w[np.minimum(reach, len(w) - 1)] == w[part][:, None])
            q = q + octave
            c = part[c]
            inside = c + q < len(w)
            c, q = c[inside], q[inside]
            if len(c):
                # Of 3 P equal places half lie on one side of the anchor.
                most = min(PROBE, -(-REACH * octave // 2))
                both = np.concatenate([_matches_on(w, c, q, 1, most), _matches_on(w, c, q, -1, most)])
                for anchor in np.unique(c[both]).tolist():
                    yield octave, anchor
        octave *= 2


def z_function(s: list[int]) -> list[int]:
    """How many items from each place on equal those from the first on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*found, n] if n > 1 else found


def solve_tile(octave: int, anchor: int, low: int, words: list[int]) -> list[tuple[int, int, int]]:
    """(period, first, end) of the equal places around the anchor, cut at the tile's reach; smallest periods only."""
    a, reach = anchor - low, REACH * octave
    after = words[a:]
    ahead = z_function(after)
    # Backwards: what precedes the anchor, then the same with up to 2 P words of what follows.
    extra = min(2 * octave, len(after))
    behind = z_function([*reversed(words[:a]), -1, *reversed(words[: a + extra])])
    found = []
    for q in range(octave, min(2 * octave, len(after))):
        forward = min(ahead[q], reach)
        if not forward:
            continue
        back = min(behind[a + 1 + extra - q], a) if a else 0
        if forward + back >= reach and not any(ahead[q // r] >= q - q // r for r in _prime_factors(q)):
            found.append((q, anchor - back, anchor + forward))
    return found


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: bool = False) -> DataFrame:
    """A row for each document, and one for each of its tiles (where ``octave`` isn't null).

    A document without a tile has no run; its row holds the digest of its words and
    no text. The others keep their text until their runs are known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for rid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split_words(text)
                words = with_tail(words, doc_id) if tail else words
                w = numbered(words)
                calm = True
                for octave, anchor in tile_places(w):
                    calm = False
                    low = max(0, anchor - REACH * octave)
                    tile = w[low : anchor + (REACH + 2) * octave]
                    rows.append((rid, None, None, None, None, octave, anchor, low, tile))
                    held += len(tile)
                    if held >= BATCH_WORDS:
                        yield _rows(rows, kinds)
                        rows, held = [], 0
                rows.append((rid, doc_id, len(words), hashlib.sha256(b" ".join(words)).hexdigest() if calm else None, None if calm else text, None, None, None, None))
            yield _rows(rows, kinds)

    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = CUT_SCHEMA.format(id=base.schema["doc_id"].dataType.simpleString())
    kinds = [pa.int64(), None, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    kinds[1] = _arrow_type(base, "doc_id")
    return base.mapInArrow(run, schema)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


NAMES = ["rid", "doc_id", "n_words", "collapsed", "text", "octave", "anchor", "low", "words"]


def _rows(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)


def solve(tiles: DataFrame) -> DataFrame:
    """(rid, period, first, end): the fragments of all tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for rid, *tile in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made += [(rid, *f) for f in solve_tile(*tile)]
            columns = list(zip(*made, strict=True)) if made else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rid", "period", "first", "end"])

    return tiles.select("rid", "octave", "anchor", "low", "words").mapInArrow(run, "rid long, period long, first long, end long")


def stitch(fragments: DataFrame) -> DataFrame:
    """(rid, start, length, period) of the runs: fragments of a document and period that touch are one."""
    ordered = Window.partitionBy("rid", "period").orderBy("first", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("new", F.when(F.col("first") <= before, 0).otherwise(1))
    joined = marked.withColumn("part", F.sum("new").over(ordered)).groupBy("rid", "period", "part").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    return joined.select("rid", "start", length.alias("length"), "period").where((F.col("length") >= LEAST) & (F.col("length") >= POWER * F.col("period")))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Of (start, length, period) the one of the greatest exact exponent, then the smallest start and period."""
    if not runs:
        return None
    top = max(1000 * length // period for _, length, period in runs)
    return min((r for r in runs if 1000 * r[1] // r[2] == top), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    turns = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        turns[start + period] += 1
        turns[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(turns[:-1]) == 0).tolist()]


REPORT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def runs_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: bool = True) -> DataFrame:
    """Runs of every row: their number, the one of the greatest exponent, and digests of all and of the text without them.

    ``tail`` lets one document in ten repeat from some place on (:func:`with_tail`);
    a null id changes nothing. Null or blank text has no word and no run. Repeated
    rows give repeated results, each told apart by a number of its own; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    cut(docs, id_col, text_col, tail).write.parquet(folder)
    made = spark.read.parquet(folder)
    tiles = made.where("octave is not null").select("rid", "octave", "anchor", "low", "words")
    spread = tiles.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid", "octave", "anchor")
    runs = stitch(solve(spread)).groupBy("rid").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split_words(text)
                words = with_tail(words, doc_id) if tail else words
                runs = sorted(((r["start"], r["length"], r["period"]) for r in found or ()), key=lambda r: (r[0], r[2]))
                start, length, period = best_run(runs) or (None, None, None)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                milli = None if start is None else 1000 * length // period
                rows.append((len(runs), start, length, period, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[batch.schema.names[0], *(x.split()[0] for x in REPORT.split(", "))])

    kind = made.schema["doc_id"].dataType.simpleString()
    whole = made.where("octave is null")
    restless = whole.where("collapsed is null").select("rid", "doc_id", "text").join(runs, "rid", "left").select("doc_id", "text", "runs")
    none = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    calm = whole.where("collapsed is not null").select("doc_id", F.lit(0).cast("long").alias("n_runs"), *none, F.sha2(F.lit(""), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
    return calm.unionByName(restless.mapInArrow(finish, f"doc_id {kind}, {REPORT}")).withColumnRenamed("doc_id", id_col)
