"""Window frames per symbol, and exponential means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scan import AT, exponential, placed

BY_SYMBOL = ("symbol",)


def ordered(*keys: str):
    return W.partitionBy(*(keys or BY_SYMBOL)).orderBy("bar_ts")


def roll(n: int, *keys: str):
    """The current row and the n - 1 before it."""
    return ordered(*keys).rowsBetween(-(n - 1), 0)


def full(n: int, made: Column, of: str = "close", *keys: str) -> Column:
    """``made`` where the frame holds n values, else null."""
    return F.when(F.count(of).over(roll(n, *keys)) == n, made)


def before(col: str | Column, k: int = 1, *keys: str) -> Column:
    return F.lag(col, k).over(ordered(*keys))


def history(*keys: str) -> Column:
    """Rows that the symbol has in all."""
    return F.count(F.lit(1)).over(W.partitionBy(*(keys or BY_SYMBOL)))


def span(n: float) -> float:
    return 2.0 / (n + 1.0)


def crossed_up(a: Column, b: Column, prev_a: Column, prev_b: Column) -> Column:
    return F.coalesce((a > b) & (prev_a <= prev_b), F.lit(False))


def crossed_down(a: Column, b: Column, prev_a: Column, prev_b: Column) -> Column:
    return F.coalesce((a < b) & (prev_a >= prev_b), F.lit(False))


def with_ema(df: DataFrame, *steps: tuple[str, str | Column, float], adjust: bool = False, keys: tuple[str, ...] = BY_SYMBOL) -> DataFrame:
    """Add exponential means (name, column, a), e_t = (1 - a) e_(t-1) + a x_t from the first non-null x.

    Made by a segmented scan (:mod:`barloom.functions.scan`), so a long history is spread over
    tasks. Steps don't see each other's results; what needs them takes another call.
    """
    made = exponential(placed(df, *keys), keys, adjust, **{name: (source, alpha) for name, source, alpha in steps})
    return made if AT in df.columns else made.drop(AT)
