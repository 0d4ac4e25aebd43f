"""BPE encoding and decoding through a table of distinct words.

Words are the runs between white space; no token of the vocabulary crosses it.
Documents are kept in blocks of bounded size, written once to a table bucketed by
block. Then

1. each block lists its distinct words, dealt out by a hash of the word,
2. every distinct word is encoded once, and its ids go back to the blocks that
   list it,
3. each block joins them to its documents by position: bucketing lets this
   happen where the documents lie, so texts are never shuffled.

Decoding is a join: each id is a row, which finds its piece in the vocabulary's table
of ids and pieces. That table is as large as the vocabulary, whatever the corpus, so
it is broadcast once its size is known to be small; rows keep their order then, and
are put together again where they are. ``decode`` joins every id of every row. For the
report, whose ids come from blocks, the distinct ids of a block's words are joined
once a task, and what they decode to goes back to the documents by position, as ids do.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from barloom.llm import tokens
from barloom.llm.common import shared_dir

#: A block is closed once it has so many characters, or so many documents.
BLOCK_CHARS, BLOCK_DOCS = 32_000_000, 50_000
#: Encoded words that a task remembers.
KNOWN = 1_000_000


def blocked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with a block number, in a bucketed table in the shared folder."""
    spark = docs.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chars, rows = TaskContext.get().partitionId() << 24, 0, 0
        for batch in batches:
            lengths = batch.column(2).to_pylist()
            mine = []
            for n in lengths:
                if rows and (chars + n > BLOCK_CHARS or rows >= BLOCK_DOCS):
                    block, chars, rows = block + 1, 0, 0
                mine.append(block)
                chars, rows = chars + n, rows + 1
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), batch.column(0), batch.column(1)], names=["block", "id", "text"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.length(text).alias("n"))
    name = f"blocks_{uuid.uuid4().hex}"
    kind = base.schema["id"].dataType.simpleString()
    made = base.mapInArrow(number, f"block long, id {kind}, text string")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark).rstrip('/')}/{name}").option("compression", "zstd").saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"drop table {name}")  # the files stay, and what has been resolved reads them by path and bucket
    return held


def words_of(text: str) -> list[str]:
    return tokens.chunks(tokens.folded(text))


def squeezed(items: list[str]) -> bytes:
    return zlib.compress("\n".join(items).encode("utf-8", "surrogatepass"), 3)


def listed_in(data: bytes) -> list[str]:
    """Undoes ``squeezed`` for a list that isn't empty; words hold no line break."""
    return zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")


def word_table(blocks: DataFrame, vocabulary: str, tokens_too: bool = False) -> DataFrame:
    """(block, words, ids): for each block its distinct words and their ids, in several rows.

    Both columns are compressed lists, since they are what is shuffled. With
    ``tokens_too`` (block, words, ids, token): before and in each such row, the ids
    that its task hasn't listed yet, one a row; if there are none, any of its ids.
    """
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for block, words in seen.items():
                dealt: dict[int, list[str]] = {}
                for w in words:
                    dealt.setdefault(zlib.crc32(w.encode("utf-8", "surrogatepass")) % parts, []).append(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dealt, pa.int32()), pa.array([block] * len(dealt), pa.int64()), pa.array([squeezed(sorted(d)) for d in dealt.values()], pa.binary())],
                    names=["p", "block", "words"],
                )
            seen.clear()

        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block not in seen and len(seen) >= 2:  # rows of a block lie together
                    yield from flush()
                seen.setdefault(block, set()).update(words_of(text))
        yield from flush()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}  # of the distinct words dealt to this task
        met: set[str] = set()  # ids listed by it
        tokenizer = tokens.library_tokenizer(vocabulary)
        for batch in batches:
            for k in range(batch.num_rows):
                words = listed_in(batch.column(2)[k].as_py())
                if len(known) > KNOWN:
                    known.clear()
                new = [w for w in words if w not in known]
                for at in range(0, len(new), 20_000):
                    part = new[at : at + 20_000]
                    for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                        known[w] = " ".join(map(str, e.ids))
                made = [known[w] for w in words]
                ids = pa.array([squeezed(made)], pa.binary())
                if not tokens_too:
                    yield pa.RecordBatch.from_arrays([batch.column(1)[k : k + 1], batch.column(2)[k : k + 1], ids], names=["block", "words", "ids"])
                    continue
                each = set(" ".join(made).split())
                new = [int(i) for i in each - met or [*each][:1]] or [None]
                met |= each
                none = pa.nulls(len(new) - 1, pa.binary())
                lists = [pa.concat_arrays([none, x]) for x in (batch.column(2)[k : k + 1].cast(pa.binary()), ids)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(1)[k].as_py()] * len(new), pa.int64()), *lists, pa.array(new, pa.int32())], names=["block", "words", "ids", "token"])

    listed = blocks.select("block", "text").mapInArrow(distinct, "p int, block long, words binary")
    return listed.repartition(parts, "p").mapInArrow(encode, "block long, words binary, ids binary" + ", token int" * tokens_too)


def pieces(vocabulary: str) -> list[str]:
    """Piece of each id, 0 first."""
    made = tokens.library_tokenizer(vocabulary)
    return [made.id_to_token(i) or "" for i in range(made.get_vocab_size(with_added_tokens=True))]


def _lists(ids: list[bytes]) -> pa.ListArray:
    """Lists of ids from their little-endian bytes."""
    ends = np.cumsum([0, *[len(b) // 4 for b in ids]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col`` and ids (array of int) of every row.

    Null text counts as empty and has no ids; null ids stay null; repeated rows
    give repeated results; an empty table gives an empty result; other columns
    are ignored, whatever their names. A vocabulary whose tokens cross white
    space is refused.
    """
    path = vocabulary or tokens.default_vocabulary()
    if not tokens.fits(path):
        raise ValueError(f"tokens of {path} may cross white space or depend on case")
    blocks = blocked(docs, id_col, text_col)

    def assemble(mine: pa.Table, table: pa.Table) -> pa.Table:
        of: dict[str, bytes] = {}
        for words, ids in zip(table.column("words").to_pylist(), table.column("ids").to_pylist(), strict=True):
            of.update((w, array("I", map(int, i.split())).tobytes()) for w, i in zip(listed_in(words), listed_in(ids), strict=True))
        made = []
        for chunk in mine.column("text").chunks:
            for at in range(0, len(chunk), 256):
                made.append(_lists([b"".join(map(of.__getitem__, words_of(t))) for t in chunk[at : at + 256].to_pylist()]))
        return pa.Table.from_arrays([mine.column("id"), pa.chunked_array(made, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = blocks.schema["id"].dataType.simpleString()
    joined = blocks.groupBy("block").cogroup(word_table(blocks, path).groupBy("block")).applyInArrow(assemble, f"id {kind}, ids array<int>")
    return joined.withColumnRenamed("id", id_col)


#: Bytes of pieces that are broadcast at most; a larger vocabulary is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def piece_table(spark: SparkSession, vocabulary: str) -> tuple[DataFrame, int]:
    """(token, piece) of the vocabulary, and how many bytes the pieces have."""
    made = pieces(vocabulary)
    rows = pa.table({"token": pa.array(range(len(made)), pa.int32()), "piece": pa.array(made, pa.string())})
    return spark.createDataFrame(rows), sum(len(p.encode("utf-8", "surrogatepass")) + 16 for p in made)


def with_pieces(encoded: DataFrame, ids_col: str, vocabulary: str) -> DataFrame:
    """A row for each id of each row of ``encoded``, (id, pos, token, piece) in order; one with a null pos where there is none.

    Ids that the vocabulary doesn't have, and null ones, have a null piece.
    """
    table, size = piece_table(encoded.sparkSession, vocabulary)
    ids = F.posexplode_outer(F.col(ids_col).cast("array<int>")).alias("pos", "token")
    if size <= BROADCAST_BYTES:
        return encoded.select("id", ids).join(F.broadcast(table), "token", "left").select("id", "pos", "token", "piece")
    each = encoded.select(F.monotonically_increasing_id().alias("row"), "id", ids).join(table, "token", "left")
    return each.repartition("row").sortWithinPartitions("row", "pos").select("id", "pos", "token", "piece")


def put_together(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[pa.Scalar, int, list[list[str]]]]:
    """For each document of a stream of rows by ``with_pieces`` its id, its number of ids and, for each of ``columns``, the texts to be joined by one space."""
    current: list | None = None
    for batch in batches:
        pos = pc.fill_null(batch.column("pos"), -1).to_numpy(zero_copy_only=False)
        if not len(pos):
            continue
        starts = np.flatnonzero(pos <= 0)
        edges = np.unique(np.concatenate([[0], starts, [len(pos)]]))
        inside = np.ones(len(pos), bool)
        inside[starts] = False
        before = np.concatenate([[current[1] - 1 if current else -1], pos[:-1]])
        if (pos[inside] != before[inside] + 1).any():
            raise RuntimeError("rows of a document's ids are out of order")
        lists = lambda c: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pc.fill_null(batch.column(c), ""))  # noqa: E731, B023
        said = [pc.binary_join(lists(c), " ").to_pylist() for c in columns]
        for k, (at, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if pos[at] <= 0:
                if current:
                    yield tuple(current)
                current = [batch.column("id")[at], 0, [[] for _ in columns]]
            if pos[at] >= 0:
                current[1] += end - at
                for texts, mine in zip(current[2], said):
                    texts.append(mine[k])
    if current:
        yield tuple(current)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``id_col`` and text: pieces of the ids, joined by one space as the library does.

    Each row of ``encoded`` gives one row; null or empty ids give empty text;
    null and unknown ids have an empty piece, and so leave only their space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _batched(put_together(batches, ("piece",))):
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i, *_ in some], kind), pa.array([" ".join(x[0]) for *_, x in some], pa.string())], names=["id", "text"])

    base = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = to_arrow_type(base.schema["id"].dataType)
    joined = with_pieces(base, "ids", vocabulary or tokens.default_vocabulary())
    return joined.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def _batched(items: Iterator, most: int = 256) -> Iterator[list]:
    while some := list(itertools.islice(items, most)):
        yield some


def words_with_pieces(blocks: DataFrame, vocabulary: str) -> DataFrame:
    """(block, words, ids, pieces): ``word_table`` and the pieces of the distinct ids of each row, found by a join."""
    table, size = piece_table(blocks.sparkSession, vocabulary)
    rows = word_table(blocks, vocabulary, tokens_too=True)
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(table), "token", "left")
    else:  # rows of a task are put in order again
        joined = rows.withColumn("row", F.monotonically_increasing_id()).join(table, "token", "left")
        joined = joined.repartition(F.shiftright("row", 33)).sortWithinPartitions("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, str] = {}  # of this task; as large as the vocabulary at most
        for batch in batches:
            found.update(zip(map(str, batch.column("token").to_pylist()), pc.fill_null(batch.column("piece"), "").to_pylist()))
            for k in np.flatnonzero(batch.column("words").is_valid().to_numpy(zero_copy_only=False)).tolist():
                each = set(" ".join(listed_in(batch.column("ids")[k].as_py())).split())
                data = zlib.compress(json.dumps({i: found[i] for i in each}).encode(), 3)  # a KeyError if rows were out of order
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[k : k + 1] for c in ("block", "words", "ids")), pa.array([data], pa.binary())], names=["block", "words", "ids", "pieces"])

    return joined.select("block", "words", "ids", "token", "piece").mapInArrow(run, "block long, words binary, ids binary, pieces binary")


def round_trip_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: number of ids, digest of the ids, digest of what they decode to.

    Ids are made as by ``encode``; the distinct ids of each block's words are joined
    to their pieces. Rows are treated as there: every row gives one, null text as
    empty text, an empty table an empty result.
    """
    path = vocabulary or tokens.default_vocabulary()
    if not tokens.fits(path):
        raise ValueError(f"tokens of {path} may cross white space or depend on case")
    blocks = blocked(docs, "doc_id", "text")
    digest = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def assemble(mine: pa.Table, table: pa.Table) -> pa.Table:
        written: dict[str, str] = {}  # each word's ids in digits
        decoded: dict[str, str] = {}
        for words, ids, found in zip(*(table.column(c).to_pylist() for c in ("words", "ids", "pieces")), strict=True):
            piece = json.loads(zlib.decompress(found))
            for w, i in zip(listed_in(words), listed_in(ids), strict=True):
                written[w], decoded[w] = i, " ".join(map(piece.__getitem__, i.split()))
        without = {w for w, i in written.items() if not i}
        made = []
        for chunk in mine.column("text").chunks:
            for at in range(0, len(chunk), 256):
                for t in chunk[at : at + 256].to_pylist():
                    words = words_of(t)
                    if without:
                        words = [w for w in words if w not in without]
                    ids = " ".join(map(written.__getitem__, words))
                    made.append((ids.count(" ") + 1 if ids else 0, digest(ids), digest(" ".join(map(decoded.__getitem__, words)))))
        columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        return pa.Table.from_arrays([mine.column("id"), *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = blocks.schema["id"].dataType.simpleString()
    joined = blocks.groupBy("block").cogroup(words_with_pieces(blocks, path).groupBy("block"))
    return joined.applyInArrow(assemble, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", "doc_id")
