"""Candlestick patterns as boolean columns over one shared window."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import before


class Candle:
    """A bar ``k`` rows back."""

    def __init__(self, k: int = 0):
        of = lambda c: F.col(c) if k == 0 else before(c, k)
        self.open, self.high, self.low, self.close = map(of, ("open", "high", "low", "close"))
        self.body, self.range = F.abs(self.close - self.open), self.high - self.low
        self.green, self.red = self.close > self.open, self.close < self.open
        self.top, self.bottom = F.greatest(self.open, self.close), F.least(self.open, self.close)


def _sure(*tests: Column) -> Column:
    return F.coalesce(reduce(and_, tests), F.lit(False))


def engulfing() -> tuple[Column, Column]:
    """Bullish and bearish."""
    a, b = Candle(1), Candle()
    return (
        _sure(a.red, b.green, b.open <= a.close, b.close >= a.open),
        _sure(a.green, b.red, b.open >= a.close, b.close <= a.open),
    )


def doji(threshold: float = 0.1) -> Column:
    c = Candle()
    return _sure(c.range > 0, F.try_divide(c.body, c.range) < threshold)


def hammer() -> Column:
    """A hammer, or one upside down."""
    c = Candle()
    upper, lower = c.high - c.top, c.bottom - c.low
    down = (lower >= 2 * c.body) & (upper <= 0.3 * c.range)
    up = (upper >= 2 * c.body) & (lower <= 0.3 * c.range)
    return _sure(c.range > 0, c.body > 0, down | up)


def _star(first: Column, second: Column, third: Column) -> Column:
    b = Candle(1)
    return _sure(first, b.range > 0, F.try_divide(b.body, b.range) <= 0.3, second, third)


def morning_star() -> Column:
    a, b, c = Candle(2), Candle(1), Candle()
    return _star(a.red, b.top < a.bottom, c.green & (c.close >= (a.open + a.close) / 2))


def evening_star() -> Column:
    a, b, c = Candle(2), Candle(1), Candle()
    return _star(a.green, b.bottom > a.top, c.red & (c.close <= (a.open + a.close) / 2))


def three_white_soldiers() -> Column:
    a, b, c = Candle(2), Candle(1), Candle()
    inside = [x for p, n in ((a, b), (b, c)) for x in (n.open > p.open, n.open < p.close, n.close > p.close)]
    return _sure(a.green, b.green, c.green, *inside)


def three_black_crows() -> Column:
    a, b, c = Candle(2), Candle(1), Candle()
    inside = [x for p, n in ((a, b), (b, c)) for x in (n.open < p.open, n.open > p.close, n.close < p.close)]
    return _sure(a.red, b.red, c.red, *inside)


NAMES = ("bullish_engulfing", "bearish_engulfing", "doji", "hammer", "morning_star", "evening_star", "three_white_soldiers", "three_black_crows")


def scan(bars: DataFrame) -> DataFrame:
    """All patterns, one sort."""
    bull, bear = engulfing()
    made = (bull, bear, doji(), hammer(), morning_star(), evening_star(), three_white_soldiers(), three_black_crows())
    return bars.withColumns(dict(zip(NAMES, made, strict=True)))


def summary(scanned: DataFrame) -> DataFrame:
    """(symbol, pattern, n) from a scanned table."""
    counts = scanned.groupBy("symbol").agg(*[F.sum(F.col(n).cast("long")).alias(n) for n in NAMES])
    return counts.unpivot("symbol", list(NAMES), "pattern", "n")
