"""Prompt templates filled by columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = {
    "answer": "Answer from the sources only and cite them by number.\n\nSources:\n$context\n\nQuestion: $question",
    "rewrite": "Rewrite the question so that a search finds its answer: $question",
    "sentiment": "Is this text bullish, bearish or neutral?\n\n$text",
    "strategy": "Describe entry and exit rules for: $request",
    "diagnosis": "Explain these backtest figures and name the largest risk:\n$report",
}


def names() -> list[str]:
    return sorted(TEMPLATES)


def add(name: str, template: str) -> None:
    if name in TEMPLATES:
        raise ValueError(f"template exists: {name}")
    TEMPLATES[name] = template


def fill(name: str, **values: Column) -> Column:
    """The template with each $name replaced by a column; a null value or a missing name stays as it stands."""
    made: list[Column] = []
    for k, part in enumerate(re.split(r"\$([a-z_]+)", TEMPLATES[name])):
        if k % 2 == 0:
            made.append(F.lit(part))
        else:
            made.append(F.coalesce(values[part].cast("string"), F.lit(f"${part}")) if part in values else F.lit(f"${part}"))
    return F.concat(*made)
