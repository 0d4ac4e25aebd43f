"""The registered queries of this subpackage and, where SQL expresses them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import ann, bpe, imatch, language, line_templates, packing, pii, quality, repetition, secrets, simhash, spelling, toxicity
from barloom.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_report(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_report(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_report(table(spark, sf_dir, "embeddings"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.imatch_report(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.runs_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_packing": op2_packing,
        "op3_secrets": op3_secrets,
        "op4_line_templates": op4_line_templates,
        "op5_language": op5_language,
        "op6_bpe": op6_bpe,
        "op7_neighbours": op7_neighbours,
        "op8_imatch": op8_imatch,
        "op9_pii": op9_pii,
        "op10_simhash": op10_simhash,
        "op11_spelling": op11_spelling,
        "op12_toxicity": op12_toxicity,
        "op13_repetition": op13_repetition,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_templates": line_templates.sql_for(), "op9_pii": pii.sql_for()}
