"""BM25 by an inverted index that is written once and searched many times.

Documents fall into blocks of some hundred by a hash. A block's texts meet in one task,
which counts each document's tokens by sorting them in its row; so texts are shuffled
once, tokens never. Postings lie by token bucket, sorted by token. Nothing is collected;
all steps are joins and sums.

A search takes the postings of its tokens, deals them by block and sums them there, so
that only the k best of each query and task are shuffled after that. On demand it skips
blocks: for each query the tokens that can add most, up to some thousand postings, give
documents whose sums by these tokens alone bound the k-th best score from below. Blocks
whose highest weights don't add up to that bound can't hold one of the k best. That
takes another pass over the postings and pays where queries hold rare tokens.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.shared import cut_lineage, parts, shared_dir
from barloom.operators.chunks import let
from barloom.operators.text import SINGLE, tokens

K1, B = 1.5, 0.75
#: Documents of a block, tokens of a bucket of files (of five characters each), and postings that the first bound is made of.
BLOCK_DOCS, BUCKET_TOKENS, FIRST_POSTINGS = 128, 50_000_000, 2000
#: Documents that a task indexes, postings that it sums, and query tokens that are sent to all tasks.
TASK_DOCS, TASK_POSTINGS, FEW_TOKENS = 16_384, 10_000_000, 500_000
#: Scores are kept at so many places; bounds are taken wider than that.
PLACES, SLACK = 9, 1e-6


@dataclass(frozen=True)
class Index:
    """Where an index lies, how many documents it has and how its tokens are found."""

    folder: str
    n: int
    mean: float
    pattern: str
    id_col: str
    buckets: int

    def postings(self, spark: SparkSession) -> DataFrame:
        """(bucket, block, token, id, tf, len): how often a document of ``len`` tokens has a token."""
        return spark.read.parquet(f"{self.folder}/postings")

    def terms(self, spark: SparkSession) -> DataFrame:
        """(token, df, top): documents that have it, and its highest weight."""
        return spark.read.parquet(f"{self.folder}/terms")

    def weight(self) -> Column:
        """What a posting adds to a score, but for the token's and the query's factor."""
        return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(self.mean)))


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _counts(words: Column) -> Column:
    """(token, tf) of each distinct word: neighbours in a sorted array."""

    def made(s: Column, starts: Column) -> Column:
        return F.transform(starts, lambda i, j: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(starts, j + 1), F.size(s)) - i).alias("tf")))

    firsts = lambda s: F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    return let(F.sort_array(words), lambda s: let(firsts(s), lambda starts: made(s, starts)))


def build(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = SINGLE) -> Index:
    """Write the index of ``docs`` under ``folder``; null text has no token. One shuffle of the documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    buckets, blocks = -(-chars // (5 * BUCKET_TOKENS)) or 1, -(-n // BLOCK_DOCS) or 1
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int")).repartition(max(parts(spark), -(-n // TASK_DOCS)), "block")
    each = dealt.select("block", "id", tokens(F.col("text"), pattern).alias("k"))
    counted = each.select("block", "id", F.size("k").alias("len"), F.explode(_counts(F.col("k"))).alias("c")).select("block", "id", "len", "c.*")
    rows = counted.withColumn("bucket", _bucket(F.col("token"), buckets)).select("bucket", "block", "token", "id", "tf", "len")
    rows.sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").parquet(f"{folder}/postings")
    schema = "block int, token string, id " + docs.schema["id"].dataType.simpleString() + ", tf int, len int, bucket int"
    total = spark.read.schema(schema).parquet(f"{folder}/postings").agg(F.sum("tf")).first()[0] or 0
    made = Index(folder, n, total / n if total else 1.0, pattern, id_col, buckets)
    if total:
        made.postings(spark).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max(made.weight()).alias("top")).write.parquet(f"{folder}/terms")
    spark.createDataFrame([(n, made.mean, buckets)], "n long, mean double, buckets int").coalesce(1).write.parquet(f"{folder}/stats")  # last: it says that the index is whole
    return made


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _mark(docs: DataFrame, *what: str) -> str | None:
    """A digest of the files that ``docs`` reads and of ``what``; None where it doesn't read files alone."""
    spark = docs.sparkSession
    files = sorted(docs.inputFiles())
    if not files or "Scan" not in docs._jdf.queryExecution().toString() or "Filter" in docs._jdf.queryExecution().optimizedPlan().toString():
        return None
    conf, made = spark._jsc.hadoopConfiguration(), hashlib.sha256("\n".join(what).encode())
    for f in files:
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        s = at.getFileSystem(conf).getFileStatus(at)
        made.update(f"{f} {s.getLen()} {s.getModificationTime()}\n".encode())
    return made.hexdigest()[:32]


def index_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = SINGLE) -> Index:
    """The index of a table of files, built in the shared folder at the first call and found there by later ones.

    It is found again while the files have the same names, sizes and times. What isn't
    read from files alone is indexed at each call.
    """
    spark = docs.sparkSession
    mark = _mark(docs.select(id_col, text_col), id_col, text_col, pattern)
    folder = f"{shared_dir(spark).rstrip('/')}/bm25-tf-{BLOCK_DOCS}-{mark or uuid.uuid4().hex}"
    if mark and _exists(spark, f"{folder}/stats/_SUCCESS"):
        n, mean, buckets = spark.read.parquet(f"{folder}/stats").first()
        return Index(folder, n, mean, pattern, id_col, buckets)
    return build(docs, folder if not mark or not _exists(spark, folder) else f"{folder}-{uuid.uuid4().hex}", id_col, text_col, pattern)


def search(index: Index, queries: DataFrame, k: int = 10, query_col: str = "item_id", text_col: str = "text", at_once: int | None = None) -> DataFrame:
    """(query_col, rank, id_col, score): the k best documents of each query, scores at nine places, ties to the smaller id.

    Only positive scores count; a token that a query repeats counts as often. Queries
    without a known token have no row. Where more than ``at_once`` postings would be
    summed, blocks that can't hold one of the k best are left out; results don't depend on it.
    """
    spark = queries.sparkSession
    kind = queries.schema[query_col].dataType.simpleString()
    if not index.n or not _exists(spark, f"{index.folder}/terms"):
        return spark.createDataFrame([], f"{query_col} {kind}, rank int, {index.id_col} long, score double")
    asked = queries.select(F.col(query_col).alias("q"), F.explode(tokens(F.coalesce(text_col, F.lit("")), index.pattern)).alias("token")).groupBy("q", "token").agg(F.count(F.lit(1)).alias("qn"))
    idf = F.ln((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    strong = W.partitionBy("q").orderBy(F.desc(F.col("f") * F.col("top")), "token").rowsBetween(W.unboundedPreceding, -1)
    known = asked.join(index.terms(spark), "token").withColumn("f", idf * F.col("qn")).withColumn("before", F.coalesce(F.sum("df").over(strong), F.lit(0)))
    known = cut_lineage(known.select("q", _bucket(F.col("token"), index.buckets).alias("bucket"), "token", "f", "before", "df"))
    n_known, n_postings = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    sent = lambda df: F.broadcast(df) if n_known <= FEW_TOKENS else df
    keys = ["bucket", "token"]
    # All of a block meets in one task before queries multiply it, and stays there until its best are chosen.
    tasks = max(parts(spark), min(-(-n_postings // TASK_POSTINGS), -(-index.n // BLOCK_DOCS)))
    wanted = index.postings(spark).join(sent(known.select(*keys).distinct()), keys, "left_semi")
    dealt = wanted.select(*keys, "block", "id", index.weight().alias("w")).repartition(tasks, "block")

    def scored(rows: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """(q, block, id, s): sums of weights by the tokens in ``rows``, over all blocks or those (q, block)."""
        met = dealt.join(sent(rows.select("q", *keys, "f")), keys)
        met = met if blocks is None else met.join(blocks, ["q", "block"], "left_semi")
        return met.groupBy("q", "block", "id").agg(F.sum(F.col("f") * F.col("w")).alias("s"))

    def worth_summing() -> DataFrame:
        """(q, block) of the blocks that may hold one of the k best."""
        # The k-th best of some tokens' sums can't be above the k-th best score.
        some = scored(known.where(F.col("before") < FIRST_POSTINGS)).withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s")))).where(F.col("r") <= k)
        least = some.groupBy("q").agg((F.when(F.count(F.lit(1)) == k, F.min("s")).otherwise(F.lit(0.0)) - SLACK).alias("least"))
        bounds = dealt.groupBy(*keys, "block").agg(F.max("w").alias("bound"))
        highest = bounds.join(sent(known), keys).groupBy("q", "block").agg(F.sum(F.col("f") * F.col("bound")).alias("most"))
        return highest.join(least, "q").where("most >= least").select("q", "block")

    few = at_once is None or n_postings <= at_once
    whole = scored(known, None if few else worth_summing()).select("q", "id", F.round("s", PLACES).alias("score")).where("score > 0")
    ranked = whole.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_col), "rank", F.col("id").alias(index.id_col), "score")
