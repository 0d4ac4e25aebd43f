"""Search over text and vectors: BM25, exact cosine, hybrid, diversity, and retrieval metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import inverted
from barloom.operators.inverted import B, K1
from barloom.operators.text import SINGLE, tokens
from barloom.operators.vectors import vector_top


def _terms(df: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), tokens(F.coalesce(text_col, F.lit("")), pattern).alias("k"))


def document_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = SINGLE) -> DataFrame:
    """(token, df)."""
    return _terms(docs, id_col, text_col, pattern).select(F.explode(F.array_distinct("k")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", query_col: str = "item_id", text_col: str = "text", pattern: str = SINGLE) -> DataFrame:
    """(query_col, id_col, score) with positive scores; repeated query tokens count as often as they occur.

    Only tokens that some query has leave the documents' tasks.
    """
    asked = _terms(queries, query_col, text_col, pattern).select(F.col("id").alias("q"), F.explode("k").alias("token")).groupBy("q", "token").agg(F.count(F.lit(1)).alias("qn"))
    made = _terms(docs, id_col, text_col, pattern).select("id", "k", F.size("k").alias("len"))
    n, mean = made.agg(F.count(F.lit(1)), F.avg("len")).first()
    if not n:
        return asked.select(F.col("q").alias(query_col), F.lit(None).cast("long").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    vocabulary = asked.select("token").distinct()
    tf = made.select("id", "len", F.explode("k").alias("token")).join(vocabulary, "token", "left_semi").groupBy("id", "len", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(mean or 1.0))))
    scored = tf.join(df, "token").join(asked, "token").groupBy("q", "id").agg(F.sum(weight * F.col("qn")).alias("score"))
    return scored.where("score > 0").select(F.col("q").alias(query_col), F.col("id").alias(id_col), "score")


def bm25_top(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", query_col: str = "item_id", text_col: str = "text", pattern: str = SINGLE) -> DataFrame:
    """(query_col, rank, id_col, score): the k best documents by ``bm25`` for each query, by an inverted index that later searches find again."""
    return inverted.search(inverted.index_of(docs, id_col, text_col, pattern), queries, k, query_col, text_col)


def top(scored: DataFrame, query_col: str, k: int, *ties: str) -> DataFrame:
    """The k best rows of each query with rank from 1; ties go by ``ties``."""
    rank = F.row_number().over(W.partitionBy(query_col).orderBy(F.desc("score"), *ties))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def hybrid(hits: DataFrame, contents: DataFrame, queries: DataFrame, k: int = 10, alpha: float = 0.7, head: int = 100) -> DataFrame:
    """Vector hits blended with the share of query tokens that a hit's text holds.

    ``hits``: query_id, doc_id, distance. ``contents``: doc_id, text. ``queries``:
    query_id, text. Hits of one query whose texts share their first ``head``
    characters are one hit, the nearest. Returns query_id, doc_id, score, rank.
    """
    farthest = F.max("distance").over(W.partitionBy("query_id"))
    vec = F.when(farthest > 0, 1 - F.col("distance") / F.nullif(farthest, F.lit(0.0))).otherwise(F.lit(1.0))
    met = hits.withColumn("vec", vec).join(contents, "doc_id").join(queries.select("query_id", F.array_distinct(tokens("text")).alias("qk")), "query_id")
    share = F.when(F.size("qk") == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("qk", tokens(F.col("text")))) / F.size("qk"))
    made = met.select("query_id", "doc_id", F.substring("text", 1, head).alias("head"), (alpha * F.col("vec") + (1 - alpha) * share).alias("score"), "distance")
    first = F.row_number().over(W.partitionBy("query_id", "head").orderBy("distance", "doc_id"))
    one = made.withColumn("n", first).where("n = 1").drop("n", "head", "distance").withColumn("score", F.round("score", 9))  # sums differ in their last digits
    return top(one, "query_id", k, "doc_id")


def rerank(candidates: DataFrame, k: int = 5, blend: float = 0.7) -> DataFrame:
    """BM25 within each query's own candidates, blended with the sigmoid of their score.

    ``candidates``: query_id, doc_id, query_text, text, score, pos (input order).
    """
    pattern = r"[a-z0-9]+"
    keys = ["query_id", "doc_id"]
    base = candidates.select(*keys, "score", "pos", tokens(F.col("query_text"), pattern).alias("qk"), tokens(F.col("text"), pattern).alias("k"))
    per = W.partitionBy("query_id")
    base = base.withColumns({"len": F.size("k"), "n": F.count(F.lit(1)).over(per)}).withColumn("mean", F.avg("len").over(per))
    tf = base.select(*keys, "len", "n", "mean", F.explode("k").alias("token")).groupBy(*keys, "len", "n", "mean", "token").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("query_id", "token")))
    asked = base.select(*keys, F.explode("qk").alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("qn"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    bm = tf.join(asked, [*keys, "token"]).groupBy(*keys).agg(F.sum(weight * F.col("qn")).alias("bm"))
    made = base.join(bm, keys, "left").withColumn("bm25", F.coalesce("bm", F.lit(0.0)))
    final = F.when(F.col("score").isNull(), F.col("bm25")).otherwise(blend * F.col("bm25") + (1 - blend) / (1 + F.exp(-F.col("score"))))
    return top(made.select(*keys, "pos", F.round(final, 9).alias("score")), "query_id", k, "pos").drop("pos")  # sums differ in their last digits


RERANKERS = {"simple": rerank, "bm25": rerank}


def reranker(name: str):
    """The reranker of a name, in any case: simple or bm25, which are the same; others raise, as does one that needs a hosted model."""
    key = name.lower().strip()
    if key not in RERANKERS:
        raise ValueError(f"unknown reranker {name!r}; available: {sorted(RERANKERS)}")
    return RERANKERS[key]


def mmr(pool: DataFrame, k: int = 5, weight: float = 0.5) -> DataFrame:
    """Greedy choice by weight * relevance - (1 - weight) * closest chosen; ties to the smaller id.

    ``pool``: query_id, vec_id, v, relevance; a query's pool is some tens of rows.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", ignore_index=True)
        x = np.stack(group["v"].to_numpy())
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        relevance, close = group["relevance"].to_numpy(), None
        left, chosen = np.ones(len(x), bool), []
        for _ in range(min(k, len(x))):
            gain = relevance if close is None else weight * relevance - (1 - weight) * close
            i = int(np.where(left, gain, -np.inf).argmax())
            chosen.append(i)
            left[i] = False
            s = x @ x[i]
            close = s if close is None else np.maximum(close, s)
        out = group.iloc[chosen][["query_id", "vec_id"]].copy()
        out["rank"], out["distance"] = range(1, len(chosen) + 1), 1 - relevance[chosen]
        return out

    return pool.select("query_id", "vec_id", "v", "relevance").groupBy("query_id").applyInPandas(run, "query_id long, vec_id long, rank int, distance double")


def ir_metrics(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """One row: mean precision at k (of k, not of what came back), recall at k and reciprocal rank, over all expected queries.

    ``ranked``: query_id, rank, relevant. ``expected``: query_id, n_expected.
    """
    per = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.col("relevant").cast("int")).alias("hits"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    each = expected.join(per, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    return each.agg(
        F.round(F.avg(hits / F.lit(float(k))), 4).alias("precision_at_k"),
        F.round(F.avg(F.coalesce(F.try_divide(hits, "n_expected"), F.lit(0.0))), 4).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
    )
