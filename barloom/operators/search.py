"""Parameter search over any template: each distinct indicator is made once for all combinations.

A template says which indicators its parameters need and, given their columns, when it
buys and sells. The search gathers what all combinations of all templates need, makes
each of these once (all exponential means in one scan), and only then multiplies the
bars, by one signal for each combination. One backtest values all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scan import AT, exponential, placed
from barloom.functions.windows import before, crossed_down, crossed_up, full, roll, span
from barloom.operators import metrics
from barloom.operators.backtest import COMMISSION
from barloom.operators.indicators import rsi_value

#: An indicator and its periods, such as ("sma", 20), or ("before", ("sma", 20)) for its value at the bar before.
Need = tuple
Look = Callable[..., Column]


@dataclass(frozen=True)
class Template:
    """``needs`` and ``rules`` get the parameters by name; rules also get a function from a need to its column, and give (buy, sell)."""

    needs: Callable[..., list[Need]]
    rules: Callable[..., tuple[Column, Column]]


def _crossing(look: Look, a: Need, b: Need) -> tuple[Column, Column]:
    sides = look(*a), look(*b), look("before", a), look("before", b)
    return crossed_up(*sides), crossed_down(*sides)


def _both(a: Need, b: Need) -> list[Need]:
    return [a, b, ("before", a), ("before", b)]


TEMPLATES: dict[str, Template] = {
    "sma_cross": Template(lambda fast, slow: _both(("sma", fast), ("sma", slow)), lambda look, fast, slow: _crossing(look, ("sma", fast), ("sma", slow))),
    "ema_cross": Template(lambda fast, slow: _both(("ema", fast), ("ema", slow)), lambda look, fast, slow: _crossing(look, ("ema", fast), ("ema", slow))),
    "rsi": Template(lambda n, low, high: [("rsi", n)], lambda look, n, low, high: (look("rsi", n) < low, look("rsi", n) > high)),
    "bands": Template(
        lambda n, k: [("sma", n), ("dev", n)],
        lambda look, n, k: (F.col("close") < look("sma", n) - k * look("dev", n), F.col("close") > look("sma", n) + k * look("dev", n)),
    ),
    "breakout": Template(
        lambda n, m: [("before", ("highest", n)), ("before", ("lowest", m))],
        lambda look, n, m: (F.col("close") > look("before", ("highest", n)), F.col("close") < look("before", ("lowest", m))),
    ),
}


def name_of(need: Need) -> str:
    return "__" + "_".join(name_of(x)[2:] if isinstance(x, tuple) else str(x) for x in need)


def with_indicators(bars: DataFrame, needs: set[Need]) -> DataFrame:
    """``bars`` with a column for each need, each made once; what a need rests on is made too."""
    needs = needs | {n[1] for n in needs if n[0] == "before"}
    by_kind = lambda kind: sorted(n for n in needs if n[0] == kind)
    made = placed(bars, "symbol")
    if means := by_kind("ema"):
        made = exponential(made, ("symbol",), **{name_of(n): ("close", span(n[1])) for n in means})
    if strengths := by_kind("rsi"):
        move = F.col("close") - before("close")
        made = made.withColumn("__move", move).withColumns({"__gain": F.when(F.col("__move").isNotNull(), F.greatest("__move", F.lit(0.0))), "__loss": F.when(F.col("__move").isNotNull(), F.greatest(-F.col("__move"), F.lit(0.0)))})
        sums = {f"{name_of(n)}_{c}": full(n[1], F.avg(f"__{c}").over(roll(n[1])), f"__{c}") for n in strengths for c in ("gain", "loss")}
        made = made.withColumns(sums).withColumns({name_of(n): rsi_value(F.col(f"{name_of(n)}_gain"), F.col(f"{name_of(n)}_loss")) for n in strengths}).drop("__move", "__gain", "__loss", *sums)
    windows = {"sma": lambda n: F.avg("close").over(roll(n)), "dev": lambda n: F.stddev_samp("close").over(roll(n)), "highest": lambda n: F.max("high").over(roll(n)), "lowest": lambda n: F.min("low").over(roll(n))}
    made = made.withColumns({name_of(n): full(n[1], w(n[1])) for kind, w in windows.items() for n in by_kind(kind)})
    return made.withColumns({name_of(n): before(name_of(n[1])) for n in needs if n[0] == "before"})


def signals_of(bars: DataFrame, combinations: list[tuple[str, dict]]) -> DataFrame:
    """(symbol, bar_ts, close, param_id, template, signal) of each combination (template, parameters), numbered in order."""
    unknown = {t for t, _ in combinations} - set(TEMPLATES)
    if unknown:
        raise ValueError(f"unknown templates {sorted(unknown)}; choose from {sorted(TEMPLATES)}")
    needs = {n for t, p in combinations for n in TEMPLATES[t].needs(**p)}
    made = with_indicators(bars, needs)
    look = lambda *need: F.col(name_of(need))
    each = []
    for i, (template, parameters) in enumerate(combinations):
        buy, sell = TEMPLATES[template].rules(look, **parameters)
        signal = F.when(sell, -1).when(buy, 1).otherwise(0)
        each.append(F.struct(F.lit(i).alias("param_id"), F.lit(template).alias("template"), signal.alias("signal")))
    return made.select("symbol", "bar_ts", "close", AT, F.explode(F.array(*each)).alias("e")).select("symbol", "bar_ts", "close", AT, "e.*")


def search(bars: DataFrame, combinations: list[tuple[str, dict]], metric: str = "total_return", commission: float = COMMISSION) -> DataFrame:
    """(symbol, param_id, template, score) of every combination; a missing score counts as 0."""
    keys = ("symbol", "param_id", "template")
    tried = metrics.backtest_metrics(signals_of(bars, combinations), keys, commission)
    return tried.select(*keys, F.coalesce(metric, F.lit(0.0)).alias("score"))
