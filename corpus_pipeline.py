"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which ``run`` writes as Parquet in the shared folder and
reads again for the next stage. All but the last return the columns of
``documents``.

In every stage null text counts as empty, rows with null ids pass or are packed
like others but are no copies of anything, repeated rows are treated alike, an
empty table gives an empty result, and further columns are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import line_templates, near_copies, packing, quality, secrets
from barloom.llm.common import drop, shared_dir, table


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars after texts have changed."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; without labels of both classes none does."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that an earlier document has go; documents stay, with empty text if no line is left."""
    return _recount(line_templates.drop_recurring_lines(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, the one with the smallest id.

    Near-copies agree in at least 0.8 of their five-word shingles: found by SimHash
    and multi-index hashing, confirmed by the exact similarity. Documents without
    a word are copies of each other.
    """
    return near_copies.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked where they stand; documents stay."""
    return _recount(secrets.redact_secrets(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Learning and tokenising have no SQL form; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; of the folders between the stages only the last remains, which the result reads."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
