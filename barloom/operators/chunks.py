"""Chunks of texts, as Catalyst expressions over each row: no Python runs, and at most the documents are dealt anew.

Pieces are packed by folds over arrays. ``let`` gives a value a name within an
expression, so that it is made once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.shared import numbered, parts

# Ends of sentences, separators from coarse to fine, clause headings at a line's start in any case.
SENTENCE_END = r"(?<=[.!?。！？；\n])\s*"
SEPARATORS = ("\n\n", "\n", "。", "，", ". ", " ", "")
HEADING = r"(?imd)(?=^(?:第[一二三四五六七八九十百千零\d]+[條章節款項]|Article\s+\d+|Section\s+\d+|\d+\.\s+))"
#: Clauses of more characters are cut again, to pieces of this size and overlap.
LONG_CLAUSE, CLAUSE_SIZE, CLAUSE_OVERLAP = 1000, 500, 50
BUCKETS = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def no_text() -> Column:
    return F.array().cast("array<string>")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def filled(parts: Column) -> Column:
    """Stripped parts without blank ones."""
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def sentences(text: Column) -> Column:
    return filled(F.split(text, SENTENCE_END))


def hard_cut(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Pieces of ``size`` characters, each starting ``size - overlap`` after the one before; blank ones go."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(max(1, size - overlap)))
    return filled(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size))))


def _packed(text: Column, size: int, overlap: int, separators: tuple[str, ...]) -> Column:
    """Pieces of a text longer than ``size``."""
    if not separators or separators[0] == "":
        return hard_cut(text, size, overlap)
    sep, later = F.lit(separators[0]), separators[1:]
    there = F.contains(text, sep)

    def given(held: Column) -> Column:
        """Pieces of what has been packed: itself, or where it is too long its pieces by later separators."""
        clean = F.when(there, stripped(held)).otherwise(held)
        return let(clean, lambda c: F.when(F.length(c) <= size, filled(F.array(c))).otherwise(_packed(c, size, overlap, later)))

    def step(state: Column, part: Column) -> Column:
        out, held = state["out"], state["held"]
        longer = F.concat(held, sep, part)

        def put(mine: Column) -> Column:
            # What follows starts with the end of the last piece given, where that is longer than the overlap.
            carried = F.when((F.size(mine) > 0) & (F.length(F.element_at(mine, -1)) > overlap), F.concat(F.right(F.element_at(mine, -1), F.lit(overlap)), sep, part)).otherwise(part)
            return F.struct(F.concat(out, mine).alias("out"), (carried if overlap else part).alias("held"))

        return (
            F.when(held.isNull(), F.struct(out.alias("out"), part.alias("held")))
            .when(part.isNotNull() & (F.length(longer) <= size), F.struct(out.alias("out"), longer.alias("held")))
            .otherwise(let(given(held), put))
        )

    # A null at the end gives out what is held.
    parts = F.concat(F.split(text, rf"\Q{separators[0]}\E", -1), F.array(F.lit(None).cast("string")))
    return F.aggregate(parts, F.struct(no_text().alias("out"), F.lit(None).cast("string").alias("held")), step, lambda s: s["out"])


def recursive_cut(text: Column, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Pieces by the first separator that occurs, packed up to ``size``; what is still too long is cut by later ones.

    A piece starts with the last ``overlap`` characters of the piece given out before,
    if that is longer than the overlap. Null and blank texts have no piece.
    """
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(F.length(t) <= size, filled(F.array(t))).otherwise(_packed(t, size, overlap, separators)))


def bigrams(text: Column) -> Column:
    """Neighbouring characters in lower case."""
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: F.concat(x, y))
    return let(F.filter(F.split(F.lower(text), ""), lambda x: x != ""), lambda c: F.when(F.size(c) > 1, pairs(c)).otherwise(no_text()))


def _codes(text: Column) -> Column:
    """Bigrams as numbers, sorted."""
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: x.cast("long") * 0x110000 + y)
    points = F.transform(F.filter(F.split(F.lower(text), ""), lambda x: x != ""), F.ascii)
    return let(points, lambda c: F.when(F.size(c) > 1, F.sort_array(pairs(c))).otherwise(F.array().cast("array<bigint>")))


def _squares(codes: Column) -> Column:
    """Sum of the squared counts of a sorted array's numbers: only places where a new number starts are folded."""
    starts = lambda s: F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    counts = lambda s, b: F.transform(b, lambda i, j: (F.coalesce(F.get(b, j + 1), F.size(s)) - i).cast("bigint"))
    return let(codes, lambda s: let(starts(s), lambda b: F.aggregate(counts(s, b), F.lit(0).cast("bigint"), lambda x, n: x + n * n)))


def _counted(text: Column) -> Column:
    """(codes, squares) of a text."""
    return let(_codes(text), lambda c: F.struct(c.alias("codes"), _squares(c).alias("squares")))


def _likeness(a: Column, b: Column) -> Column:
    """Cosine of the bigram counts of two ``_counted`` texts, 0 if one has none.

    The squared counts of both together, less those of each, are twice the product;
    two sorted arrays are sorted together in one pass.
    """
    both = _squares(F.sort_array(F.concat(a["codes"], b["codes"])))
    dot = F.shiftright(both - a["squares"] - b["squares"], 1)
    return F.coalesce(F.try_divide(dot.cast("double"), F.sqrt((a["squares"] * b["squares"]).cast("double"))), F.lit(0.0))


def semantic_cut(text: Column, threshold: float = 0.5, least: int = 50, most: int = 1000) -> Column:
    """Sentences grouped while neighbours' bigram counts agree by ``threshold``.

    Groups longer than ``most`` are cut again; those shorter than ``least`` join the
    piece before where both together aren't longer than ``most``. A text of one sentence
    is given whole, null and blank texts have no piece.
    """

    def grouped(s: Column) -> Column:
        coded = F.transform(s, _counted)
        begins = lambda c: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (_likeness(F.get(c, i - 1), F.get(c, i)) < threshold))
        joined = lambda b: F.transform(b, lambda i, k: F.array_join(F.slice(s, i + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - i), " "))
        return let(let(coded, begins), joined)

    def step(out: Column, group: Column) -> Column:
        last = F.element_at(out, -1)
        joins = (F.length(group) < least) & (F.size(out) > 0) & (F.length(last) + 1 + F.length(group) <= most)
        return (
            F.when(F.length(group) > most, F.concat(out, _packed(group, most, 0, SEPARATORS)))
            .when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, F.lit(" "), group))))
            .otherwise(F.concat(out, F.array(group)))
        )

    whole = F.coalesce(text, F.lit(""))
    return let(sentences(whole), lambda s: F.when(F.size(s) <= 1, filled(F.array(whole))).otherwise(F.aggregate(grouped(s), no_text(), step)))


def clauses(text: Column) -> Column:
    """Parts of a text before clause headings, or between blank lines if that gives one part only; long ones are cut again."""
    by_heading = filled(F.split(text, HEADING))
    parts = F.when(F.size(by_heading) > 1, by_heading).otherwise(filled(F.split(text, r"\n\s*\n")))
    again = lambda p: F.when(F.length(p) > LONG_CLAUSE, recursive_cut(p, CLAUSE_SIZE, CLAUSE_OVERLAP)).otherwise(F.array(p))
    return F.flatten(F.transform(parts, again))


def _exploded(docs: DataFrame, id_col: str, pieces: Column) -> DataFrame:
    return docs.select(id_col, F.posexplode(pieces).alias("pos", "chunk"))


def recursive_split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, pos, chunk) by :func:`recursive_cut`."""
    return _exploded(docs, id_col, recursive_cut(F.col(text_col), **how))


def semantic_split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, pos, chunk) by :func:`semantic_cut`, whose folds take long: a few files keep all cores busy."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    if docs.rdd.getNumPartitions() < 4 * spark.sparkContext.defaultParallelism:
        docs = docs.repartition(max(parts(spark), 4 * spark.sparkContext.defaultParallelism))
    return _exploded(docs, id_col, semantic_cut(F.col(text_col), **how))


def clause_split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, chunk) by :func:`clauses`; null and blank texts have no chunk."""
    return _exploded(docs, id_col, clauses(F.coalesce(text_col, F.lit(""))))


def placed(text: Column, pieces: Column) -> Column:
    """Each piece with start_idx and end_idx, looked for behind the end of the one before; one that isn't found as it is starts there."""

    def step(state: Column, piece: Column) -> Column:
        at = F.position(piece, text, state["at"] + 1) - 1
        start = F.when(at < 0, state["at"]).otherwise(at)
        end = start + F.length(piece)
        one = F.struct(piece.alias("chunk"), start.alias("start_idx"), end.alias("end_idx"))
        return F.struct(F.concat(state["out"], F.array(one)).alias("out"), F.when(at < 0, state["at"]).otherwise(end).alias("at"))

    start = F.struct(F.array().cast("array<struct<chunk:string,start_idx:int,end_idx:int>>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(pieces, start, step, lambda s: s["out"])


def chunk_id(source: Column, number: Column, content: Column) -> Column:
    """Source, number and the head of the content's digest."""
    return F.concat(source.cast("string"), F.lit("::chunk_"), number.cast("string"), F.lit("_"), F.substring(F.md5(content), 1, 8))


def chunk_ids(chunks: DataFrame, source: str, content: str, *order: str) -> DataFrame:
    """Adds chunk_id, numbered over all chunks by source and ``order``."""
    made = numbered(chunks, source, *order, out="__number")
    return made.withColumn("chunk_id", chunk_id(F.col(source), F.col("__number"), F.col(content))).drop("__number")


STRATEGIES: dict[str, Callable[..., Column]] = {"recursive": recursive_cut, "semantic": semantic_cut, "financial": clauses}


def split_documents(docs: DataFrame, strategy: str = "recursive", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, pos, chunk, start_idx, end_idx, chunk_id) by a named strategy: recursive, semantic or financial; others raise.

    Numbers in chunk ids run over all documents, by id and place.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown splitting strategy {strategy!r}; choose from {list(STRATEGIES)}")
    whole = F.coalesce(text_col, F.lit(""))
    found = let(STRATEGIES[strategy](whole, **how), lambda p: placed(whole, p))
    each = docs.select(id_col, F.posexplode(found).alias("pos", "x")).select(id_col, "pos", "x.*")
    return chunk_ids(each, id_col, "chunk", "pos")


def bigram_vectors(rows: DataFrame, keys: list[str], text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(keys, bucket, weight): bigram counts hashed into buckets, as a unit vector; buckets without a bigram are left out.

    A bigram's bucket is the head of its md5 digest, so it is the same everywhere.
    Texts of fewer than two characters have no row.
    """
    place = F.pmod(F.conv(F.substring(F.md5(F.col("b")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    counts = rows.select(*keys, F.explode(bigrams(F.col(text_col))).alias("b")).groupBy(*keys, place.alias("bucket")).count()
    norms = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("count") * F.col("count")).cast("double")).alias("norm"))
    return counts.join(norms, keys).select(*keys, "bucket", (F.col("count") / F.col("norm")).alias("weight"))
