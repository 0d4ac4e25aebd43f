"""Spelling variants: words one edit apart, by products of blocked letter-count matrices.

Two words that differ by one inserted or deleted letter have letter counts at
squared distance 1, by one replaced letter at squared distance 2. Squared distances
of many words at once are one matrix product, |x|² + |y|² - 2 x·y.

Products over all words would grow with their square, so words are blocked first.
Letters fall into four groups; an edit changes the counts of two groups at most, so
two near words have equal counts in some two of the four. Each word is entered under
its counts in every two groups (six blocks). A large block is cut by the words'
lengths and these into pieces, and only pieces of equal or adjacent lengths meet.
Pairs at squared distance 1 or 2 are verified letter by letter, and a pair that meets
in several blocks is kept in the first of them, so nothing is listed twice.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut_lineage, text_or_empty

LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
GROUPS = 4
SIDES = list(itertools.combinations(range(GROUPS), 2))
#: Words of a block that are compared in one product; larger blocks are cut into pieces of about half of it.
BLOCK = 4096
#: Small blocks are put together until they have so many words.
TOGETHER = 256
#: Rows of a product at a time.
STRIPE = 512
#: Float32 counts exactly up to this length of words.
SHORT = 2000
#: Words that a task counts before it passes its counts on.
HELD = 400_000

#: One byte for each code point up to 255: letters from À on as they are, A-Z in lower case, all else blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_rng = np.random.default_rng(11)
#: Factors of the sums that number a group's counts.
FACTORS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIXERS = _rng.integers(1, 1 << 63, (len(SIDES), 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Letters are dealt to the groups by their number, so that none depends on a language.
GROUP_OF = np.arange(256) % GROUPS


def letter_runs(text: str) -> list[bytes]:
    """Maximal runs of [A-Za-z\\u00C0-\\u00FF] with A-Z in lower case, in Latin-1."""
    return text.encode("latin-1", "replace").translate(FOLD).split()


def misspelt(run: bytes, crc: int, every: int) -> bytes:
    """The run without one letter where ``every`` divides its checksum."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), crc)
    if h % every:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 0) -> DataFrame:
    """(word, n) of the words of at least seven letters that occur at least twice.

    ``every`` plants slips: a run whose crc32 after ``<id>:`` it divides loses a letter,
    so that variants exist whose form is known; 0 plants none. A null id counts as an
    empty one there. Null text has no word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                crc = zlib.crc32(f"{doc_id}:".encode())
                for w, n in Counter(letter_runs(text)).items():
                    if len(w) >= LEAST_LETTERS:
                        w = misspelt(w, crc, every) if every else w
                        if len(w) >= LEAST_LETTERS:
                            held[w] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    base = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All letters one after another, and the number of the word that each belongs to."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    return flat, np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))


def block_keys(words: list[bytes]) -> np.ndarray:
    """For each word (a row) the numbers of its six blocks."""
    flat, own = _letters(words)
    sums = np.zeros((len(words), GROUPS), np.uint64)
    np.add.at(sums, (own, GROUP_OF[flat]), FACTORS[flat])
    return np.stack([(sums[:, a] * m[0] + sums[:, b] * m[1] + np.uint64(k)).view(np.int64) for k, ((a, b), m) in enumerate(zip(SIDES, MIXERS, strict=True))], axis=1)


def _entered(words: DataFrame) -> DataFrame:
    """(block, kind, word, n): each word under its six blocks; ``kind`` says which two groups a block is of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                keys = block_keys([w.encode("latin-1") for w in batch.column(0).to_pylist()])
                row = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
                kind = pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int8), batch.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), kind, batch.column(0).take(row), batch.column(1).take(row)], names=["block", "kind", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "block long, kind tinyint, word string, n long")


def _cells(entries: DataFrame, block_size: int) -> DataFrame:
    """(cell, side, kind, word, n): what meets in one product.

    A block of bounded size is a cell. A larger one is cut into pieces by length, and
    each two pieces of equal or adjacent lengths are a cell, in which the words of side 1
    meet those of side 2 (or all meet, side 0, where it is one piece).
    """
    size = F.length("word")
    sizes = entries.groupBy("block", size.alias("size")).count()
    large = sizes.groupBy("block").agg(F.sum("count").alias("all")).where(F.col("all") > block_size).select("block")
    number = F.ceil(F.col("count") / (block_size // 2)).cast("int")
    pieces = sizes.join(large, "block").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("size", number.alias("number")))).alias("pieces"))

    held = lambda length: F.coalesce(F.try_element_at("pieces", length), F.lit(0))
    each = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.col("mine")

    def cell(low: Column, high: Column, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("block", low, high, i, j).alias("cell"), side.cast("tinyint").alias("side"))

    same = F.transform(each(held(size)), lambda j: cell(size, size, F.least(mine, j), F.greatest(mine, j), F.when(j == mine, 0).when(j > mine, 1).otherwise(2)))
    longer = F.transform(each(held(size + 1)), lambda j: cell(size, size + 1, mine, j, F.lit(1)))
    shorter = F.transform(each(held(size - 1)), lambda j: cell(size - 1, size, j, mine, F.lit(2)))
    joined = entries.join(pieces, "block", "left")
    whole = joined.where("pieces is null").select(F.col("block").alias("cell"), F.lit(0).cast("tinyint").alias("side"), "kind", "word", "n")
    cut = joined.where("pieces is not null").withColumn("mine", F.pmod(F.xxhash64("word"), held(size)).cast("int"))
    return whole.unionByName(cut.select(F.explode(F.concat(same, longer, shorter)).alias("c"), "kind", "word", "n").select("c.cell", "c.side", "kind", "word", "n"))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _verified(words: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of places are exactly one edit apart."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    most = int(max(sizes[i].max(), sizes[j].max()))
    if most > 64:
        return np.fromiter((one_edit(words[x], words[y]) for x, y in zip(i.tolist(), j.tolist())), bool, len(i))
    ahead = np.zeros((len(words), most), np.uint8)
    back = np.zeros((len(words), most), np.uint8)
    flat, own = _letters(words)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = sizes[own] <= most
    ahead[own[fits], at[fits]] = flat[fits]
    back[own[fits], (sizes[own] - 1 - at)[fits]] = flat[fits]
    found = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 15):
        x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        short = np.minimum(sizes[x], sizes[y])
        same = lambda m: np.minimum(np.where((d := m[x] != m[y]).any(axis=1), d.argmax(axis=1), most), short)  # noqa: E731, B023
        joint = same(ahead) + same(back)
        found[k : k + (1 << 15)] = joint >= np.where(sizes[x] == sizes[y], short - 1, short)
    return found


def near_places(words: list[bytes], cell: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, the first before the second, of words of one cell that are exactly one edit apart."""
    flat, own = _letters(words)
    used, column = np.unique(flat, return_inverse=True)
    sizes = np.bincount(own, minlength=len(words))
    kind = np.float32 if sizes.max(initial=0) <= SHORT else np.float64
    counts = np.bincount(own * len(used) + column, minlength=len(words) * len(used)).reshape(len(words), -1).astype(kind)
    square = (counts * counts).sum(axis=1)
    several = cell[0] != cell[-1]
    sided = bool(side.any())
    first, second = [], []
    for at in range(0, len(words), STRIPE):
        rows = slice(at, at + STRIPE)
        distance = square[rows, None] + square[None, at:] - 2 * (counts[rows] @ counts[at:].T)
        ok = (distance > 0.5) & (distance < 2.5)
        if several:
            ok &= cell[rows, None] == cell[None, at:]
        if sided:
            ok &= (side[rows, None] != side[None, at:]) | (side[rows, None] == 0)
        i, j = np.nonzero(ok)
        up = i < j
        first.append(i[up] + at)
        second.append(j[up] + at)
    i, j = np.concatenate(first), np.concatenate(second)
    near = np.abs(sizes[i] - sizes[j]) <= 1
    i, j = i[near], j[near]
    if len(i):
        right = _verified(words, i, j)
        i, j = i[right], j[right]
    return i, j


def _solved(cell: np.ndarray, side: np.ndarray, kind: np.ndarray, words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    i, j = near_places(raw, cell, side)
    if len(i):  # a pair belongs to the first block that its words share
        ends = np.unique(np.concatenate([i, j]))
        keys = block_keys([raw[k] for k in ends.tolist()])
        shared = (keys[np.searchsorted(ends, i)] == keys[np.searchsorted(ends, j)]).argmax(axis=1)
        mine = shared == kind[i]
        i, j = i[mine], j[mine]
    return pa.RecordBatch.from_arrays([words.take(pa.array(i)), pa.array(n[i]), words.take(pa.array(j)), pa.array(n[j])], names=["a", "n_a", "b", "n_b"])


def near_pairs(words: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words exactly one edit apart, once.

    ``words`` has distinct ``word`` (letters up to U+00FF) and ``n``. An empty table gives
    an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            """Results of the whole cells, and then what is left."""
            batch = table.combine_chunks()
            cell, side, kind, n = (batch.column(k).to_numpy() for k in (0, 1, 2, 4))
            words = batch.column(3).combine_chunks()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            ends = starts[1:] if last else starts[1:-1]
            at = 0
            for k, end in enumerate(ends.tolist()):
                following = int(ends[k + 1]) if k + 1 < len(ends) else None
                if following is None or following - at > TOGETHER:
                    if end - at > 1:
                        yield _solved(cell[at:end], side[at:end], kind[at:end], words.slice(at, end - at), n[at:end])
                    at = end
            yield table.slice(at)

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            *made, rest = solve(table if rest is None else pa.concat_tables([rest, table]), False)
            yield from made
        if rest is not None and len(rest):
            *made, _ = solve(rest, True)
            yield from made

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = _cells(_entered(words), block_size).select("cell", "side", "kind", "word", "n")
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "a string, n_a long, b string, n_b long")


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``words`` with n_near, the number of near words, form and form_n.

    A word's form is its most frequent near word (of several the first in code-point
    order), where that is at least ``times`` as frequent; else null.
    """
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    found = near_pairs(words).select(F.explode(ends).alias("e")).select("e.*")
    best = found.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best")).select("word", "n_near", "best.near", (-F.col("best.col1")).alias("near_n"))
    frequent = F.col("near_n") >= times * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(frequent, F.col("near")).alias("form"), F.when(frequent, F.col("near_n")).alias("form_n"))


def with_roots(made: DataFrame) -> DataFrame:
    """``made`` with root: where the forms lead from a word in the end.

    Each form is at least ten times as frequent as the word before, so a chain is
    short; every round of joins doubles the steps taken.
    """
    steps = cut_lineage(made.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut_lineage(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = joined.select("word", "root")
        if not joined.where("moved").take(1):
            return made.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_report(docs: DataFrame, every: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words.

    Null text has no word and a null id counts as an empty one when slips are planted
    (see :func:`word_counts`). Repeated rows count as often as they occur. Words of equal
    frequency are taken in code-point order. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    words = cut_lineage(word_counts(docs, every=every))
    return with_roots(cut_lineage(forms(words))).select("word", "form", "root", "n", "n_near", "form_n")
