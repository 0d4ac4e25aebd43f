"""Packing token sequences into windows by best-fit decreasing.

Documents are tokenised once. An overlong document is first cut into full
windows, each a sequence of its own; what remains of it, and every shorter
document, is packed. Remainders are dealt to groups of bounded size by a hash of
the row, and each group packs longest first: a segment tree indexed by
remaining capacity finds the tightest open window that still fits.

Groups hold some thousands of documents, so the one half-empty window at a
group's end is a few hundredths of a percent of its tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import tokens
from barloom.llm.common import text_or_empty

WINDOW = 4096
END_ID = 2
DOCS_PER_GROUP = 8192


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree of counts over capacities 0..size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the smallest capacity >= need, or None."""
        at = need + self.leaves
        if not self.count[at]:
            # Up to the first subtree to the right that holds a window, then down its left edge.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        window = self.stacks[capacity].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length; lengths are 1..size."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found = (size, opened)
            opened += 1
        capacity, window[i] = found
        offset[i] = size - capacity
        if capacity > need:
            tree.add(capacity - need, window[i])
    return window, offset


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """Each document's ids, then ``end_id``, cut into full windows and a remainder."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.memo(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = known.encode(text) + end
                n = len(ids) // 4
                view = memoryview(ids)
                out += [(doc, at, min(window, n - at), zlib.crc32(view[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(run, PIECE)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    docs_per_group: int = DOCS_PER_GROUP,
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Documents no longer than a window are never cut. A
    sequence id is unique over all groups but ids have gaps.

    Null text counts as empty and gives a piece of the end id alone; null ids
    stay null; repeated rows are packed as often as they occur; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    groups = max(1, -(-docs.count() // docs_per_group))
    made = pieces(docs, id_col, text_col, vocabulary or tokens.default_vocabulary(), window, end_id)
    # A document has one remainder, so groups have about docs_per_group of them. Full windows
    # need no packing but take their sequence ids from the same groups. The row's number spreads
    # rows that are alike in all else.
    dealt = made.withColumn("grp", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start", F.monotonically_increasing_id()), F.lit(groups)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        at, offset = best_fit_decreasing(group.column("length").to_numpy(), window)
        sequence = at + group.column("grp").to_numpy() * 2**32
        return group.drop_columns("grp").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # Arrow, not pandas: a null id would turn pandas' column of ids to floats.
    return dealt.groupBy("grp").applyInArrow(run, PIECE + ", sequence_id long, offset long")
