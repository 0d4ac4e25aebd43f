"""Instruction samples: loading, checking, generating and saving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import text

# The categories of samples.
CATEGORIES = ("sentiment", "qa", "summary", "analysis")
SCHEMA = "instruction string, input string, output string, category string"
POOLS = {
    "sentiment": [("Judge the mood of this note.", "Orders rose for the third month.", "bullish"), ("Judge the mood of this note.", "The plant stays closed.", "bearish"), ("Judge the mood of this note.", "Nothing changed today.", "neutral")],
    "qa": [("Answer the question.", "What does a moving average do?", "It smooths a series by averaging its last values."), ("Answer the question.", "What is drawdown?", "The loss from the highest value so far.")],
    "summary": [("Sum up the text.", "Sales were up, costs were flat, and the outlook stays as it was.", "Higher sales at equal costs.")],
    "analysis": [("Discuss the figures.", "Win rate 40 %, mean gain twice the mean loss.", "Gains outweigh losses although most trades lose.")],
}


def load(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a .jsonl file or a .json array; other endings raise. Rows of unknown category go."""
    if path.endswith(".jsonl"):
        rows = spark.read.schema(SCHEMA).json(path)
    elif path.endswith(".json"):
        rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    else:
        raise ValueError(f"unknown ending: {path}")
    return rows.where(F.col("category").isin(*CATEGORIES))


def save(samples: DataFrame, path: str) -> None:
    samples.select("instruction", "input", "output", "category").write.json(path)


def generate(spark: SparkSession, n: int) -> DataFrame:
    """``n`` samples, the categories and their pools taken in turn."""
    pool = [(c, i, *row) for c, rows in POOLS.items() for i, row in enumerate(rows)]
    table = spark.createDataFrame(pool, "category string, i long, instruction string, input string, output string")
    sizes = F.create_map(*[x for c, rows in POOLS.items() for x in (F.lit(c), F.lit(len(rows)))])
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    numbered = spark.range(n).withColumn("category", F.get(names, (F.col("id") % len(CATEGORIES)).cast("int")))
    numbered = numbered.withColumn("i", F.floor(F.col("id") / len(CATEGORIES)) % sizes[F.col("category")])
    return numbered.join(F.broadcast(table), ["category", "i"]).select("id", "instruction", "input", "output", "category")


def formatted(samples: DataFrame, form: str) -> DataFrame:
    """``alpaca`` keeps three fields; ``chatml`` nests them as system, user and assistant messages; others raise."""
    if form == "alpaca":
        return samples.select("instruction", "input", "output")
    if form == "chatml":
        say = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
        return samples.select(F.array(say("system", "instruction"), say("user", "input"), say("assistant", "output")).alias("messages"))
    raise ValueError(f"unknown form: {form}")


def evaluate(predictions: DataFrame) -> DataFrame:
    """(category, n, accuracy, bleu1, rouge_l): label accuracy of sentiment rows, word scores of the others.

    ``predictions``: id, category, output (expected), prediction.
    """
    base = predictions.select("id", "category", F.coalesce("output", F.lit("")).alias("output"), F.coalesce("prediction", F.lit("")).alias("prediction"))
    scored = text.rouge_l(base, "output", "prediction").join(text.bleu1(base, ["id"], "output", "prediction"), "id")
    right = text.label_correct(F.col("prediction"), F.col("output")).cast("double")
    feeling = F.col("category") == "sentiment"
    return scored.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(feeling, right)).alias("accuracy"),
        F.avg(F.when(~feeling, F.col("bleu1"))).alias("bleu1"),
        F.avg(F.when(~feeling, F.col("rouge_l"))).alias("rouge_l"),
    )
