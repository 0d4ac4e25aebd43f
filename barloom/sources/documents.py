"""Documents from text files, and a vector collection kept as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import retrieval, text

# File endings by kind.
MARKDOWN, PLAIN = ("md", "markdown"), ("txt", "text")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(source, pos, title, content, doc_type) of all text and Markdown files below ``path``.

    Markdown is cut before headings, plain text at blank lines; other files are passed over.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    ending = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    files = files.withColumn("ending", ending).withColumn("source", F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1))
    md = text.markdown_sections(files.where(F.col("ending").isin(*MARKDOWN))).withColumn("doc_type", F.lit("markdown"))
    plain = text.paragraphs(files.where(F.col("ending").isin(*PLAIN))).withColumn("doc_type", F.lit("text"))
    return md.unionByName(plain)


class VectorCollection:
    """Rows (vec_id, content, metadata, embedding) in a Parquet folder."""

    SCHEMA = "vec_id long, content string, metadata map<string,string>, embedding array<float>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, rows: DataFrame) -> None:
        """Append; null metadata values become empty strings."""
        fields = [f.split(" ")[0] for f in self.SCHEMA.split(", ")]
        clean = F.transform_values("metadata", lambda k, v: F.coalesce(v.cast("string"), F.lit("")))
        rows.withColumn("metadata", clean).select(*[F.col(f) for f in fields]).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def count(self) -> int:
        return self.rows().count()

    def clear(self) -> None:
        self.spark.createDataFrame([], self.SCHEMA).write.mode("overwrite").parquet(self.path)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, rank, vec_id, content, metadata, distance) of the k nearest by cosine; ``queries``: vec_id, embedding."""
        own = self.rows()
        # Stored rows and queries are told apart by sign, so that equal ids do not hide each other.
        asked = queries.select((-F.col("vec_id") - 1).alias("vec_id"), "embedding")
        near = retrieval.vector_top(own, asked, k).withColumn("query_id", -F.col("query_id") - 1)
        return near.join(own, "vec_id").select("query_id", "rank", "vec_id", "content", "metadata", (1 - F.col("score")).alias("distance"))
