"""SimHash near-duplicates at a stated similarity: wide fingerprints and multi-index hashing.

``simhash`` links 64-bit fingerprints at three bits. Two texts that share 0.8 of
their five-word shingles differ in about 15 of 100 bits, so here the fingerprint
has 480 bits, cut into segments. A text is entered into each segment's table under
its own value, and looks up the likely part of the Hamming ball around it: a
majority that was won narrowly is the one that an edit turns, so the ball has the
values that differ in any of the segment's narrowest bits. Two fingerprints meet if
all bits in which some segment differs are narrow for one of them. How wide segments
are follows from the number of texts, so that few meet by chance (:data:`WIDTHS`).
By simulation two texts at exactly 0.8 meet with a chance of 0.99 at 24 bits and
five narrow ones, 0.97 at 28 and six, 0.96 at 32 and seven; at 0.85 and more with
0.99 at all of them.

What meets is verified twice: by the complete distance, then by the exact
Jaccard similarity of both sets of shingles.

Texts of equal words are one node. In some rounds, each value has one of its own
nodes as a hub, another in each round; every node of the value is compared with the
nearest of its hubs, and what is linked is joined. So a dense group becomes one root
before anything else. Then the nodes of each own value are dealt into blocks of bounded
size, distances between nodes of different roots are taken block by block, and what is
near enough is joined to clouds. The same follows for looked up values, but only for
those whose nodes are of several clouds, some segments after others. Within each cloud all nodes of different roots
are compared exactly, again block by block. No step lists pairs: a task passes on an
edge only where it joins what its edges didn't join before.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WIDE_LOT, cut_lineage, text_or_empty
from barloom.llm.components import Joined, components

WIDTH, LEAST = 5, 0.8
#: Bits of the fingerprint; bits of a segment and narrow ones among them, up to so many texts.
TOTAL = 480
WIDTHS = ((1 << 17, 24, 5), (1 << 20, 28, 6), (1 << 40, 32, 7))
#: Rounds with hubs before pairs are listed.
ROUNDS = 2
LANES = 8
#: First segments of the steps in which balls are looked up; dense clouds are whole after the first, so the others find little left.
STEPS = (0, 1, 5)
#: Complete distance of a candidate at most; 0.8 gives 73 with a deviation of 8 (10 for texts of few shingles).
MAX_BITS = 105
#: Nodes of a value that are compared in one block, and rows that small blocks are put together to.
BLOCK, TOGETHER = 2048, 256
SEED = 42
CHUNK = 4096
#: Texts that a worker takes out of a batch at once, and fingerprints whose values it holds at once.
FEW, PRINTS = 64, 256
_rng = np.random.default_rng(SEED)
FACTORS, SHIFTS = (_rng.integers(0, 1 << 63, (2, LANES), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the shingles; one of the whole text if it has fewer words."""
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def margins(hashes: np.ndarray) -> np.ndarray:
    """For each of the fingerprint's bits, how many more hashes set it than not."""
    counts = np.zeros(LANES * 64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        mixed = hashes[at : at + CHUNK, None] * FACTORS[0] + SHIFTS[0]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * FACTORS[1] + SHIFTS[1]
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # so many ones fit into a byte
            counts += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return (2 * counts - len(hashes))[:TOTAL]


def width_for(n: int) -> tuple[int, int]:
    """Bits of a segment and narrow ones among them for so many texts."""
    return next((bits, narrow) for most, bits, narrow in WIDTHS if n <= most)


def entry(margin: np.ndarray, width: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint as 64-bit words, and the places of each segment's narrowest bits."""
    bits, narrow = width
    set_bits = np.concatenate([margin > 0, np.zeros(LANES * 64 - len(margin), bool)])
    places = np.argsort(np.abs(margin[: TOTAL // bits * bits]).reshape(-1, bits), axis=1, kind="stable")[:, :narrow]
    return np.packbits(set_bits, bitorder="little").view(np.int64), places.astype(np.uint8)


def keys(words: np.ndarray, places: np.ndarray, width: tuple[int, int], ball: bool = True) -> np.ndarray:
    """For each fingerprint (a row) its segments' values, told apart by segment: (rows, segments, values), its own first, then those of the ball."""
    (bits, narrow), n = width, len(words)
    segments = TOTAL // bits
    each = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")[:, : segments * bits]
    place = np.int64(1) << np.arange(bits, dtype=np.int64)
    found = [each.reshape(n, segments, bits) @ place + (np.arange(segments, dtype=np.int64) << bits)]
    for i in range(narrow if ball else 0):
        found += [f ^ place[places.reshape(n, segments, narrow)[:, :, i]] for f in found]
    return np.stack(found, axis=2)


def _node(words: list[bytes]) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def _each_words(texts: pa.Array) -> Iterator[list[bytes]]:
    """Words of one text after another; those of a whole batch take some ten times its bytes."""
    for at in range(0, len(texts), FEW):
        yield from map(_words, texts.slice(at, FEW).to_pylist())


def _fingerprinted(base: DataFrame, width: tuple[int, int]) -> DataFrame:
    """(id, node, fp, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(_node(w), *entry(margins(shingles(w)), width)) for w in _each_words(batch.column(1))]
            columns = [pa.array([m[0] for m in made], pa.int64()), _lists([m[1] for m in made]), pa.array([m[2].tobytes() for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "node", "fp", "places"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, node long, fp array<long>, places binary")


#: Sizes of the filters that keep what surely isn't needed from being shuffled; primes, whatever the corpus.
FILTERS = (134_217_689, 134_217_593)
#: Parts in which the driver fetches a filter's bits.
FETCHES = 16


class _Bits:
    """A filter's bits, packed while they are sent and lie on the disks of driver and executors; a worker opens them once."""

    def __init__(self, bits: np.ndarray) -> None:
        self.packed, self.shape, self.opened = zlib.compress(bits, 1), bits.shape, None

    def bits(self) -> np.ndarray:
        if self.opened is None:
            self.opened, self.packed = np.frombuffer(zlib.decompress(self.packed), np.uint8).reshape(self.shape), None
        return self.opened


def _filter(values: DataFrame, column: str):
    """Bits for each value's remainders by two primes, for the tasks: 32 MB at most. What passes is checked by a join."""
    each = values.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), (F.pmod(column, F.lit(p)) + 1).alias("place")) for i, p in enumerate(FILTERS)])).alias("x")).select("x.*")
    rows = each.select("f", F.bitmap_bucket_number("place").alias("b"), F.bitmap_bit_position("place").alias("p")).groupBy("f", "b").agg(F.bitmap_construct_agg("p").alias("bits"))
    found = np.zeros((2, max(FILTERS) // 32768 + 2, 4096), np.uint8)
    for r in rows.repartition(FETCHES).toLocalIterator():  # some MB at a time, where collecting holds all of it several times over
        found[r.f, r.b] = np.frombuffer(r.bits, np.uint8)
    return values.sparkSession.sparkContext.broadcast(_Bits(found))


def _passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    ok = np.ones(len(values), bool)
    for f, p in enumerate(FILTERS):
        place = values[ok] % p
        within = place % 32768
        ok[ok] = (bits[f, place // 32768 + 1, within // 8] >> (within % 8).astype(np.uint8)) & 1 > 0
    return ok


def _entered(nodes: DataFrame, width: tuple[int, int], wanted=None, *more: str, ball: bool = True, segments: slice = slice(None)) -> DataFrame:
    """(key, node, own, and ``more`` longs of nodes): each node under its own values and those of its balls, in some of the segments; with a filter, those that pass it."""
    names = ["key", "node", "own", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PRINTS):
                batch = whole.slice(at, PRINTS)
                words = batch.column(1).flatten().to_numpy().reshape(-1, LANES)
                places = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8)
                made = keys(words, places, width, ball)[:, segments]
                kept = np.ones(made.shape, bool) if wanted is None else _passes(wanted.value.bits(), made.ravel()).reshape(made.shape)
                row, _, of_ball = np.nonzero(kept)
                rest = [pa.array(batch.column(k).to_numpy()[row]) for k in range(3, 3 + len(more))]
                yield pa.RecordBatch.from_arrays([pa.array(made[kept]), pa.array(batch.column(0).to_numpy()[row]), pa.array(of_ball == 0), *rest], names=names)

    return nodes.select("node", "fp", "places", *more).mapInArrow(run, ", ".join(["key long, node long, own boolean", *(f"{m} long" for m in more)]))


def _sets(base: DataFrame, wanted) -> DataFrame:
    """(node, s): shingles of the texts whose nodes pass the filter, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes = np.fromiter(map(_node, _each_words(batch.column(0))), np.int64, batch.num_rows)
            firsts = np.sort(np.unique(nodes, return_index=True)[1])
            kept = firsts[_passes(wanted.value.bits(), nodes[firsts])]
            kept = kept[[n not in seen for n in nodes[kept].tolist()]] if len(kept) else kept
            seen.update(nodes[kept].tolist())
            for at in range(0, len(kept), FEW):
                some = kept[at : at + FEW]
                sets = [shingles(w).view(np.int64) for w in _each_words(batch.column(0).take(pa.array(some)))]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), _lists(sets)], names=["node", "s"])

    return base.select("text").mapInArrow(run, "node long, s array<long>")


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _with(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``value`` of both ends of pairs (a, b), as <value>a and <value>b."""
    for end in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(end), F.col(value).alias(f"{value}{end}")), end)
    return pairs


def _verified(close: DataFrame, base: DataFrame, n: int | None = None) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar enough; sets are made of the texts of these pairs alone."""
    met = cut_lineage(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), n)
    sets = cut_lineage(_sets(base, _filter(met, "node")).join(met, "node", "left_semi").dropDuplicates(["node"]), n, WIDE_LOT)
    both = F.size(F.array_intersect("sa", "sb"))
    return _with(close, sets, "s").where(both >= LEAST * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _joined(labels: DataFrame, links: DataFrame, n: int | None = None) -> DataFrame:
    """``labels`` (node, root) after links between nodes."""
    roots = _with(links, labels, "root").select(F.col("roota").alias("a"), F.col("rootb").alias("b"))
    top = components(roots, rows=n).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return cut_lineage(labels.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), n)


def _shared(nodes: DataFrame, width: tuple[int, int], n: int | None = None) -> DataFrame:
    """The entries of nodes under own values that several share; made a second time, so that what isn't shared is counted alone."""
    counted = _entered(nodes, width, ball=False).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    values = cut_lineage(counted.where("n > 1").select("key"), n)
    return cut_lineage(_entered(nodes, width, _filter(values, "key"), ball=False).join(values, "key", "left_semi"), n)


def _apart(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, own, root, n) of the entries under values whose nodes have several roots; n is how many they are."""
    named = entries.join(labels, "node")
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("own").alias("any"), F.count(F.lit(1)).alias("n")).where("low < high and any").select("key", "n")
    return named.join(mixed, "key").select("key", "node", "own", "root", "n")


def _still_apart(nodes: DataFrame, labels: DataFrame, width: tuple[int, int], wanted, segments: slice, n: int | None = None) -> DataFrame:
    """(key, node, own, root, cloud, n) of the entries, looked up ones too, under values of some segments whose nodes are of several roots and of several clouds (node, root, cloud).

    Nodes of one cloud are compared in any case, so what they have in common is
    counted by value and goes no further: entries are made a second time for the values that are left.
    """
    marked = nodes.join(labels, "node").select("node", "fp", "places", "root", "cloud")
    ends = [f(c).alias(f"{c}_{k}") for c in ("root", "cloud") for k, f in (("low", F.min), ("high", F.max))]
    counted = _entered(marked, width, wanted, "root", "cloud", segments=segments).groupBy("key").agg(*ends, F.max("own").alias("any"), F.count(F.lit(1)).alias("n"))
    mixed = cut_lineage(counted.where("any and root_low < root_high and cloud_low < cloud_high").select("key", "n"), n)
    return _entered(marked, width, _filter(mixed, "key"), "root", "cloud", segments=segments).join(mixed, "key").select("key", "node", "own", "root", "cloud", "n")


def _close(fp: np.ndarray, may: Callable[[slice], np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs, the first before the second, that may be compared and are at most so many bits apart."""
    for at in range(0, len(fp), 128):
        i, j = np.nonzero(may(slice(at, at + 128)))
        i = i + at
        i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1) <= most
            yield x[near], y[near]


def _by_cell(batches: Iterator[pa.RecordBatch], names: list[str], together: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells, rows of equal ``names``, and the number of each row's cell; small cells are put together."""

    def numbered(table: pa.Table) -> np.ndarray:
        columns = np.stack([table.column(c).to_numpy() for c in names], axis=1)
        return np.concatenate([[0], np.cumsum((columns[1:] != columns[:-1]).any(axis=1))])

    rest = None
    for batch in _and_none(batches):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
        if rest is None or not len(rest):
            continue
        number = numbered(rest)
        ends = [*(np.flatnonzero(np.diff(number)) + 1).tolist(), *([len(rest)] if batch is None else [])]
        at = 0
        for k, end in enumerate(ends):
            if k + 1 == len(ends) or ends[k + 1] - at > together:
                yield rest.slice(at, end - at), number[at:end]
                at = end
        rest = rest.slice(at)


def _and_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def _fps(table: pa.Table) -> np.ndarray:
    return table.column("fp").combine_chunks().flatten().to_numpy().reshape(-1, LANES).view(np.uint64)


def _dealt(rows: DataFrame, count: Column, group: str) -> DataFrame:
    """Rows with i, j and side: each two blocks of a ``group`` meet in a cell, of ``count`` rows in all; side 1 meets side 2, and all meet in side 0."""
    blocks = F.when(count <= BLOCK, 1).otherwise(F.ceil(count / (BLOCK // 2))).cast("int")
    held = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cell = lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"), F.when(j == F.col("mine"), 0).when(j > F.col("mine"), 1).otherwise(2).cast("tinyint").alias("side"))
    made = held.withColumn("c", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cell)))
    return made.select(*[c for c in rows.columns if c != "n"], "c.*")


def _sorted_cells(rows: DataFrame, *names: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *names).sortWithinPartitions(*names)


def _sides_meet(side: np.ndarray, rows: slice) -> np.ndarray:
    return (side[rows, None] != side[None]) | (side[rows, None] == 0)


def _clouds(apart: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): edges that join nodes of different roots and clouds, each node its own cloud where there are none, which meet under a value and are at most MAX_BITS apart.

    Pairs aren't listed: a task gives an edge only where its nodes weren't joined by
    its edges before, so edges follow the number of nodes.
    """
    if "cloud" not in apart.columns:
        apart = apart.withColumn("cloud", F.col("node"))
    cells = _dealt(apart, F.col("n"), "key").join(nodes.select("node", "fp"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for table, same in _by_cell(batches, ["key", "i", "j"], TOGETHER):
            node, own, root, cloud, side = (table.column(c).to_numpy() for c in ("node", "own", "root", "cloud", "side"))
            may = lambda r: (same[r, None] == same[None]) & (root[r, None] != root[None]) & (cloud[r, None] != cloud[None]) & (own[r, None] | own[None]) & _sides_meet(side, r)  # noqa: E731, B023
            edges = [(x, y) for i, j in _close(_fps(table), may, MAX_BITS) for x, y in zip(node[i].tolist(), node[j].tolist()) if joined.join(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _sorted_cells(cells, "key", "i", "j").mapInArrow(run, "a long, b long")


def _linked(clouds: DataFrame, labels: DataFrame, nodes: DataFrame, base: DataFrame, n: int | None = None) -> DataFrame:
    """(a, b): edges that join what is similar enough within each cloud (node, cloud), found by exact comparison of all its nodes of different roots.

    The nodes of a cloud meet block by block, each with its set of shingles; edges follow the number of nodes.
    """
    members = clouds.join(labels, "node")
    several = members.groupBy("cloud").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("cloud", "n")
    members = cut_lineage(members.join(several, "cloud").select("cloud", "node", "root", "n"), n)
    met = members.select("node")
    sets = cut_lineage(_sets(base, _filter(met, "node")).join(met, "node", "left_semi").dropDuplicates(["node"]), n, WIDE_LOT)
    cells = _dealt(members, F.col("n"), "cloud").join(nodes.select("node", "fp"), "node").join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for table, same in _by_cell(batches, ["cloud", "i", "j"], TOGETHER):
            node, root, side = (table.column(c).to_numpy() for c in ("node", "root", "side"))
            lists = table.column("s").combine_chunks()
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            grams = [values[ends[k] : ends[k + 1]] for k in range(len(lists))]  # distinct, see shingles()
            may = lambda r: (same[r, None] == same[None]) & (root[r, None] != root[None]) & _sides_meet(side, r)  # noqa: E731, B023
            edges = []
            for i, j in _close(_fps(table), may, MAX_BITS):
                for x, y in zip(i.tolist(), j.tolist()):
                    p, q = int(node[x]), int(node[y])
                    if joined.top(p) != joined.top(q):
                        both = len(np.intersect1d(grams[x], grams[y], assume_unique=True))
                        if both >= LEAST * (len(grams[x]) + len(grams[y]) - both) and joined.join(p, q):
                            edges.append((p, q))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _sorted_cells(cells, "cloud", "i", "j").mapInArrow(run, "a long, b long")


def _grown(edges: DataFrame | None, more: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges of clouds and ``more`` of them as a forest, and the clouds (node, cloud) that they make, of two nodes at least."""
    tops = components(more if edges is None else edges.unionByName(more), rows=n).select("node", F.col("root").alias("cloud"))
    # A cloud's smallest node is no row of components().
    clouds = cut_lineage(tops.unionByName(tops.select(F.col("cloud").alias("node"), "cloud").distinct()), n)
    return tops.select(F.col("node").alias("a"), F.col("cloud").alias("b")), clouds


def groups(nodes: DataFrame, base: DataFrame, width: tuple[int, int], n: int | None = None) -> DataFrame:
    """(node, root) for all ``nodes``, ``n`` at most where that is known; a root stands for its group. ``base`` holds the texts."""
    entries = n and n * (TOTAL // width[0])
    wanted = _filter(_entered(nodes, width, ball=False), "key")
    labels = nodes.select("node", F.col("node").alias("root"))

    alike = _shared(nodes, width, entries)
    for k in range(ROUNDS):
        members = cut_lineage(_apart(alike, labels), entries)
        hubs = members.groupBy("key").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(k))).alias("hub"))
        starred = members.join(hubs, "key").where("root <> hub.root").select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
        stars = _with(starred, nodes, "fp").withColumn("d", _distance("fpa", "fpb"))
        nearest = cut_lineage(stars.where(F.col("d") <= MAX_BITS).groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select("a", "best.b"), n)
        if not nearest.take(1):
            break
        labels = _joined(labels, _verified(nearest, base, n), n)

    edges, clouds = _grown(None, _clouds(_apart(alike, labels), nodes), n)
    for first, last in zip(STEPS, (*STEPS[1:], TOTAL // width[0])):
        marked = cut_lineage(labels.join(clouds, "node", "left").select("node", "root", F.coalesce("cloud", "node").alias("cloud")), n)
        edges, clouds = _grown(edges, _clouds(_still_apart(nodes, marked, width, wanted, slice(first, last), entries), nodes), n)
    return _joined(labels, _linked(clouds, labels, nodes, base, n), n)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-copies: the one with the smallest id.

    Columns stay. Rows with a null id are kept, since nothing tells them apart.
    Null text counts as empty, and all texts without a word are one group; a text
    of fewer than five words has itself as its only shingle. Repeated rows of the
    kept document stay repeated; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    n = base.count()
    width = width_for(n)
    made = cut_lineage(_fingerprinted(base, width))
    first = lambda c: F.first(c).alias(c)  # noqa: E731  equal within a node
    nodes = made.groupBy("node").agg(F.min("id").alias("first"), first("fp"), first("places"))
    # Each row becomes some hundred, so rows are spread before; by a key of its own, see simhash.link_fingerprints.
    nodes = cut_lineage(nodes.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("node", F.lit(1))))
    named = nodes.select("node", "first").join(groups(nodes, base, width, n), "node")
    # The smallest id of a group has the smallest of its node.
    kept = named.groupBy("root").agg(F.min("first").alias(id_col)).select(id_col).distinct()
    return docs.join(kept, id_col, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
