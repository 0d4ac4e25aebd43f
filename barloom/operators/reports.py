"""Readable reports of backtest metrics: text, Markdown or JSON, one column made by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.metrics import LIMITS, TITLES

# Limits of the bands.
BANDS = {
    "sharpe": ((2.0, "excellent"), (1.0, "good"), (0.0, "fair")),
    "win_rate": ((0.6, "high"), (0.4, "medium")),
    "drawdown": ((0.1, "low"), (0.2, "medium")),
}


def risk_band(kind: str, value: Column) -> Column:
    """Band of a value: drawdown by upper limits, the others by lower ones."""
    made = F
    for limit, name in BANDS[kind]:
        made = made.when(value <= limit if kind == "drawdown" else value >= limit, F.lit(name))
    return made.otherwise(F.lit("high" if kind == "drawdown" else "low"))


def _lines(rated: DataFrame, form: str) -> Column:
    value = lambda m: F.coalesce(F.format_number(F.col(m).cast("double"), 4), F.lit("-"))
    if form == "markdown":
        head = [F.concat(F.lit("## "), F.col("name")), F.lit(""), F.concat(F.lit("**Score:** "), F.format_number("overall_score", 2)), F.lit(""), F.lit("| Metric | Value | Rating |"), F.lit("| --- | --- | --- |")]
        rows = [F.concat(F.lit(f"| {TITLES[m]} | "), value(m), F.lit(" | "), F.col(f"rating_{m}"), F.lit(" |")) for m in LIMITS]
        lead = "- "
    else:
        head = [F.concat(F.col("name"), F.lit(": score "), F.format_number("overall_score", 2))]
        rows = [F.concat(F.lit(f"{TITLES[m]}: "), value(m), F.lit(" ("), F.col(f"rating_{m}"), F.lit(")")) for m in LIMITS]
        lead = "  "
    lists = [F.when(F.size(c) > 0, F.concat(F.lit(f"{t}:\n{lead}"), F.array_join(c, f"\n{lead}"))) for t, c in (("Strengths", "strengths"), ("Weaknesses", "weaknesses"), ("Warnings", "risk_warnings"))]
    return F.concat_ws("\n", *head, *rows, *lists)


def report(rated: DataFrame, name: str = "symbol", form: str = "text") -> DataFrame:
    """(name, report) of rated metrics; ``form``: text, markdown or json, others raise."""
    named = rated.withColumn("name", F.col(name).cast("string"))
    if form == "json":
        fields = [F.struct(F.col(m).alias("value"), F.col(f"rating_{m}").alias("rating")).alias(m) for m in LIMITS]
        body = F.to_json(F.struct("name", "overall_score", F.struct(*fields).alias("metrics"), "strengths", "weaknesses", "risk_warnings"))
    elif form in ("text", "markdown"):
        body = _lines(named, form)
    else:
        raise ValueError(f"unknown form: {form}")
    return named.select(name, body.alias("report"))
