"""Tokens, similarity, citations and training formats."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.shared import nth_digest, numbered

# Token patterns.
MIXED = r"[一-鿿]+|[a-z]+|\d+"
SINGLE = r"[一-鿿]|[a-z]+|\d+"
PLAIN = r"[a-z0-9]+"


def tokens(text: Column, pattern: str = SINGLE) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def token_set(text: Column) -> Column:
    """Distinct words, numbers and runs of Chinese characters, and the single characters of those runs."""
    found = tokens(text, MIXED)
    singles = F.regexp_extract_all(F.lower(text), F.lit("([一-鿿])"), F.lit(1))
    return F.array_distinct(F.concat(found, singles))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common items of two arrays; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Cosine of two texts' character-bigram counts in lower case; 0 if one has fewer than two characters.

    Both texts lie in one row, so they are counted there, by batches, and nothing is shuffled.
    """

    @F.pandas_udf("double")
    def made(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s: str | None, t: str | None) -> float:
            if not s or not t or len(s) < 2 or len(t) < 2:
                return 0.0
            p, q = Counter(zip(s, s[1:])), Counter(zip(t, t[1:]))
            dot = sum(n * q[g] for g, n in p.items() if g in q)
            return dot / (math.sqrt(sum(n * n for n in p.values())) * math.sqrt(sum(n * n for n in q.values())))

        return pd.Series([one(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

    return made(F.lower(a), F.lower(b))


def bigram_cosine(pairs: DataFrame, keys: list[str], a: str, b: str, out: str = "similarity") -> DataFrame:
    """(keys, out): bigram similarity of two columns."""
    return pairs.select(*keys, bigram_similarity(F.col(a), F.col(b)).alias(out))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def markdown_sections(docs: DataFrame, id_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, pos, title, content) cut before headings of one to three marks; without a heading the title is the id."""
    parts = F.filter(F.split(text_col, r"(?m)(?=^#{1,3} )"), lambda p: F.trim(p) != "")
    each = docs.select(id_col, F.posexplode(parts).alias("pos", "content"))
    title = F.regexp_extract("content", r"^#{1,3}\s+([^\n]+)", 1)
    return each.select(id_col, "pos", F.when(title != "", F.trim(title)).otherwise(F.col(id_col).cast("string")).alias("title"), F.trim("content").alias("content"))


def paragraphs(docs: DataFrame, id_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, pos, title, content) by blank lines; titles are numbered where there are several."""
    parts = F.filter(F.transform(F.split(text_col, "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    each = docs.select(id_col, F.size(parts).alias("n"), F.posexplode(parts).alias("pos", "content"))
    stem = F.col(id_col).cast("string")
    return each.select(id_col, "pos", F.when(F.col("n") > 1, F.concat(stem, F.lit("_para_"), F.col("pos").cast("string"))).otherwise(stem).alias("title"), "content")


def citations(answer: Column) -> Column:
    """Numbers in square brackets, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)))


def citations_valid(answer: Column, n_sources: Column) -> Column:
    """True without citations; false without sources; else all must be 1..n."""
    found = citations(answer)
    return F.when(F.size(found) == 0, True).when(n_sources == 0, False).otherwise(F.forall(found, lambda c: c.cast("long").between(1, n_sources)))


def cited(answer: Column, sources: Column) -> Column:
    """The sources cited, in order; numbers out of range are passed over."""
    return F.array_compact(F.transform(citations(answer), lambda c: F.get(sources, c.cast("int") - 1)))


def confidence(distances: Column, answer: Column) -> Column:
    """0 to 1 from mean distance, number of hits and number of brackets in the answer."""
    n = F.size(distances)
    mean = F.try_divide(F.aggregate(distances, F.lit(0.0), lambda s, x: s + x), n)
    brackets = F.length(answer) - F.length(F.replace(answer, F.lit("["), F.lit("")))
    parts = 0.5 * F.greatest(F.lit(0.0), 1 - mean) + 0.25 * F.least(F.lit(1.0), n / 3) + 0.25 * F.when(brackets > 0, F.least(F.lit(1.0), brackets / 4)).otherwise(F.lit(0.3))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), parts)), 2))


def bleu1(pairs: DataFrame, keys: list[str], ref: str, hyp: str) -> DataFrame:
    """(keys, bleu1): clipped word precision times min(1, length ratio), words by white space; counted within each row."""
    words = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")

    @F.pandas_udf("double")
    def made(r: pd.Series, h: pd.Series) -> pd.Series:
        def one(x, y) -> float:
            x, y = ([] if w is None else list(w) for w in (x, y))
            if not y:
                return 0.0
            have = Counter(x)
            met = sum(min(n, have[w]) for w, n in Counter(y).items() if w in have)
            return met / len(y) * min(1.0, len(y) / max(len(x), 1))

        return pd.Series([one(x, y) for x, y in zip(r, h, strict=True)], dtype="float64")

    return pairs.select(*keys, made(words(ref), words(hyp)).alias("bleu1"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence in O(len(b)) memory, by bit vectors over positions of a."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = 0
    for w in b:
        x = row | at.get(w, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def rouge_l(pairs: DataFrame, ref: str, hyp: str, out: str = "rouge_l") -> DataFrame:
    """Adds the F-measure of the longest common subsequence of words."""

    @F.pandas_udf("double")
    def made(r: pd.Series, h: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float:
            p, q = (x or "").split(), (y or "").split()
            n = lcs_length(p, q) if p and q else 0
            return 2 * n / (len(p) + len(q)) if n else 0.0

        return pd.Series([one(x, y) for x, y in zip(r, h, strict=True)])

    return pairs.withColumn(out, made(ref, hyp))


LABELS = ("bullish", "bearish", "neutral")


def label_found(prediction: Column) -> Column:
    """The first of the labels that the text holds."""
    low = F.lower(prediction)
    made = F
    for name in LABELS:
        made = made.when(low.contains(name), F.lit(name))
    return made.otherwise(F.lit(None).cast("string"))


def label_correct(prediction: Column, expected: Column) -> Column:
    return F.coalesce(F.lower(expected).contains(label_found(prediction)), F.lit(False))


def alpaca(instruction: Column, input: Column, output: Column) -> Column:
    return F.struct(instruction.alias("instruction"), input.alias("input"), output.alias("output"))


def chatml(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv, messages): turns of each conversation as an array of (role, content)."""
    made = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", F.col("text").alias("content")))).alias("m"))
    return made.select(conv, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def train_test(df: DataFrame, key: str, test_ratio: float = 0.1, least: int = 1) -> DataFrame:
    """Adds part: train for exactly max(``least``, int(n (1 - ratio))) rows of n, test for the others.

    Rows go by the digest of their key, so the order is random and the same at every
    run. The digest at the cut is found by counting, not by sorting; rows that share it
    are told apart by numbers of their own.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    n = df.count()
    wanted = max(least, int(n * (1 - test_ratio)))
    if wanted >= n:
        return df.withColumn("part", F.lit("train"))
    cut, smaller = nth_digest(df.select(digest.alias("digest")), wanted)
    at_cut = df.where(digest == cut)
    part = F.when(digest < cut, "train").otherwise("test")
    if at_cut.count() == wanted - smaller:
        return df.withColumn("part", F.when(digest <= cut, "train").otherwise("test"))
    tied = numbered(at_cut, key, out="__number").withColumn("part", F.when(F.col("__number") < wanted - smaller, "train").otherwise("test")).drop("__number")
    return df.where(digest != cut).withColumn("part", part).unionByName(tied)


def preview(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


# Labels of sources.
SOURCE, PAGE, TITLE, CONTENT, SOURCES = "来源: ", "页码: ", "标题: ", "内容: ", "来源列表:"


def _labels(source: str, page: str | None, title: str | None) -> list[Column]:
    """Source, page and title with their labels; null where a hit has none."""
    known = lambda c: F.lit(None).cast("string") if c is None else F.nullif(F.col(c).cast("string"), F.lit(""))
    return [F.concat(F.lit(SOURCE), F.coalesce(F.col(source).cast("string"), F.lit(""))), F.concat(F.lit(PAGE), known(page)), F.concat(F.lit(TITLE), known(title))]


def _in_order(hits: DataFrame, query: str, rank: str, part: Column, separator: str, out: str) -> DataFrame:
    made = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), part.alias("s")))).alias("h"))
    return made.select(query, F.array_join(F.transform("h", lambda x: x["s"]), separator).alias(out))


def context(hits: DataFrame, query: str, rank: str, content: str = "content", source: str = "source", page: str | None = None, title: str | None = None) -> DataFrame:
    """(query, context): numbered hits of each query in rank order with source and, where known, page and title; a blank line between them."""
    label = F.concat_ws(", ", *_labels(source, page, title))
    part = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] ("), label, F.lit(")\n"), F.coalesce(content, F.lit("")))
    return _in_order(hits, query, rank, part, "\n\n", "context")


def source_list(hits: DataFrame, query: str, rank: str, content: str = "content", source: str = "source", page: str | None = None, title: str | None = None) -> DataFrame:
    """(query, sources): the hits of each query in rank order, with source, page and title where known, and the head of the content."""
    lines = [F.concat(F.lit("  "), x) for x in (*_labels(source, page, title), F.concat(F.lit(CONTENT), preview(F.coalesce(content, F.lit("")))))]
    part = F.concat_ws("\n", F.concat(F.lit("\n["), F.col(rank).cast("string"), F.lit("]")), *lines)
    made = _in_order(hits, query, rank, part, "\n", "sources")
    return made.withColumn("sources", F.concat(F.lit(SOURCES + "\n" + "=" * 50 + "\n"), F.col("sources")))
