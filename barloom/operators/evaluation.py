"""Quality of retrieval and of answers, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.retrieval import ir_metrics
from barloom.operators.text import bigram_similarity, jaccard, token_set

#: A hit is relevant if its token overlap with an expected content exceeds this.
RELEVANT = 0.1


def mark_relevant(hits: DataFrame, expected: DataFrame, least: float = RELEVANT) -> DataFrame:
    """``hits`` (query_id, rank, content) with relevant: whether any expected content of the query overlaps enough.

    ``expected`` has query_id and content. Token sets are made once for each text, and
    a query's hits meet its own expected contents only.
    """
    wanted = expected.select("query_id", token_set(F.col("content")).alias("__e"))
    had = hits.withColumn("__h", token_set(F.col("content")))
    pairs = had.select("query_id", "rank", "__h").join(wanted, "query_id").where(jaccard(F.col("__h"), F.col("__e")) > least)
    good = pairs.select("query_id", "rank").distinct().withColumn("relevant", F.lit(True))
    return hits.join(good, ["query_id", "rank"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def evaluate_retrieval(hits: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """One row: precision_at_k, recall_at_k, mrr and num_queries over all queries that expect something."""
    sizes = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    made = ir_metrics(mark_relevant(hits.where(F.col("rank") <= k), expected), sizes, k)
    return made.crossJoin(sizes.agg(F.count(F.lit(1)).alias("num_queries")))  # one row each


def keyword_share(answer: Column, keywords: Column) -> Column:
    """Share of the keywords whose lower-case form the answer, as it is, contains; null without keywords."""
    return F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda w: answer.contains(F.lower(w)))) / F.size(keywords))


def evaluate_answers(cases: DataFrame, question: str = "question", answer: str = "answer", context: str = "context", keywords: str | None = None) -> DataFrame:
    """Adds faithfulness (overlap with the context), relevancy and overall, their mean.

    Relevancy is the share of expected keywords in the answer where a case has
    some, else the likeness of question and answer.
    """
    faithful = jaccard(token_set(F.col(answer)), token_set(F.col(context)))
    relevant = bigram_similarity(F.col(question), F.col(answer))
    if keywords is not None:
        relevant = F.coalesce(keyword_share(F.col(answer), F.col(keywords)), relevant)
    made = cases.withColumn("faithfulness", faithful).withColumn("relevancy", relevant)
    return made.withColumn("overall", 0.5 * F.col("faithfulness") + 0.5 * F.col("relevancy"))


def run_evaluation(cases: DataFrame, hits: DataFrame, expected: DataFrame, k: int = 5, keywords: str | None = "keywords") -> tuple[DataFrame, DataFrame]:
    """(per case, summary) of retrieval and answers together.

    ``cases``: query_id, question, answer, keywords. The context of a case are its
    hits' contents in order. A case without hits or expected contents scores 0
    for retrieval. The summary is one row of means, rounded to four places.
    """
    first = hits.where(F.col("rank") <= k)
    said = first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), " ").alias("context"))
    found = mark_relevant(first, expected).groupBy("query_id").agg(
        F.sum(F.col("relevant").cast("int")).alias("n_relevant"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.count(F.lit(1)).alias("num_retrieved")
    )
    sizes = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    made = cases
    for side in (said, found, sizes):
        made = made.join(side, "query_id", "left")
    hit = F.coalesce("n_relevant", F.lit(0))
    made = made.withColumns(
        {
            "context": F.coalesce("context", F.lit("")),
            "num_retrieved": F.coalesce("num_retrieved", F.lit(0)),
            "precision": hit / F.lit(float(k)),
            "recall": F.coalesce(F.try_divide(hit, "n_expected"), F.lit(0.0)),
            "mrr": F.coalesce(1.0 / F.col("first"), F.lit(0.0)),
        }
    )
    each = evaluate_answers(made, keywords=keywords)
    mean = lambda c: F.round(F.avg(c), 4)
    summary = each.agg(
        F.count(F.lit(1)).alias("total_cases"), mean("precision").alias("precision_at_k"), mean("recall").alias("recall_at_k"), mean("mrr").alias("mrr"),
        mean("faithfulness").alias("faithfulness"), mean("relevancy").alias("relevancy"), F.round((F.avg("faithfulness") + F.avg("relevancy")) / 2, 4).alias("overall"),
    )
    return each.drop("first", "n_relevant", "n_expected"), summary
