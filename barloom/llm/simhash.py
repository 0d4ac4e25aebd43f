"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64-bit majorities over the XXH64 values of word shingles.
Fingerprints that differ in at most three bits are linked. Links are found among
distinct fingerprints, in two steps that never list the pairs of a dense group:

1. Whole fingerprint as one segment. Each fingerprint is entered under every
   value of its Hamming ball of radius one (65 rows). Two fingerprints at
   distance one or two meet under a common value; a value holds at most 65
   fingerprints, which are linked to the smallest of them as a star.
2. Two 32-bit segments. A pair at distance three differs in at most one bit in
   one of its halves. Each half is stored once and looked up under the 33 values
   of its ball of radius one; matches from different components of step 1 are
   verified by their complete distance.

The components of both steps' links are what all links together give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut_lineage, text_or_empty
from barloom.llm.components import components

SEED = 42
MAX_BITS = 3
CHUNK = 1 << 16


def fingerprint(text: str, width: int = 3, fold: bool = True) -> int:
    """Fingerprint of one text as an unsigned integer; 0 if it has no word."""
    raw = text.encode("utf-8", "surrogatepass")
    words = (raw.lower() if fold else raw).split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.dtype("<u8"), n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint's 64 bits as a signed long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["id", "fp"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(run, "id long, fp long").withColumnRenamed("id", id_col)


def _ball(value: Column, bits: int) -> Column:
    """The value itself and every value one bit away."""
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(bits)])


def _tagged(values: Column, segment: int) -> Column:
    """Values of a 32-bit segment, told apart from those of other segments."""
    return F.transform(values, lambda v: v + F.lit(segment << 32))


def _near_stars(distinct: DataFrame) -> DataFrame:
    """Star links between fingerprints at distance one or two."""
    entered = distinct.select("fp", F.explode(_ball(F.col("fp"), 64)).alias("key"))
    met = entered.groupBy("key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    hub = F.array_min("fps")
    return met.select(hub.alias("b"), F.explode(F.array_remove("fps", hub)).alias("a")).select("a", "b").distinct()


def _segment_links(labelled: DataFrame) -> DataFrame:
    """Links at distance three between components; ``labelled`` has fp and root."""
    halves = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))]
    stored = labelled.select("fp", "root", F.explode(F.concat(*[_tagged(F.array(h), i) for i, h in enumerate(halves)])).alias("key"))
    probes = labelled.select(
        F.col("fp").alias("fp2"),
        F.col("root").alias("root2"),
        F.explode(F.concat(*[_tagged(_ball(h, 32), i) for i, h in enumerate(halves)])).alias("key"),
    )
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MAX_BITS
    met = stored.join(probes, (stored["key"] == probes["key"]) & (F.col("root") != F.col("root2")) & close)
    return met.select(F.greatest("root", "root2").alias("a"), F.least("root", "root2").alias("b")).distinct()


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Distinct ``fp`` to (fp, root): the components of the graph of links at three bits or fewer."""
    # Each row becomes 65, so rows are spread before, not after; by a key of its own, since Spark
    # would leave out a second exchange by fp and merge the first, whose rows are short.
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp", F.lit(1)))
    first = components(_near_stars(distinct))
    labelled = cut_lineage(distinct.join(first, distinct["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")))
    second = components(_segment_links(labelled))
    return labelled.join(second, labelled["root"] == second["node"], "left").select("fp", F.coalesce(second["root"], labelled["root"]).alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Every row's fingerprint and the smallest document id reachable from it.

    Returns ``id_col``, ``fp`` (signed long) and ``component_id``. Rows of equal
    fingerprints are one node, so copies cost nothing. Null or blank text has
    fingerprint zero and links like any other. Rows whose id is null take part in
    links but name no component; a component of such rows only has a null id.
    Repeated rows give repeated results, an empty table an empty result; other
    columns are ignored, whatever their names.
    """
    made = cut_lineage(fingerprints(docs, id_col, text_col, width))
    distinct = made.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    linked = link_fingerprints(distinct.select("fp"))
    named = linked.join(distinct, "fp")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return made.join(by_fp, "fp").select(id_col, "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
