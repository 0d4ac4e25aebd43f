"""Technical indicators: each takes bars and returns them with more columns.

A value that lacks history is null. ``guarded`` variants are null for the whole
symbol when it has fewer rows than the period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scan import AT, placed
from barloom.functions.windows import BY_SYMBOL, before, crossed_down, crossed_up, full, history, ordered, roll, span, with_ema


def sma(bars: DataFrame, n: int = 20, partial: bool = False, out: str = "sma") -> DataFrame:
    mean = F.avg("close").over(roll(n))
    return bars.withColumn(out, mean if partial else full(n, mean))


def wma(bars: DataFrame, n: int = 20, out: str = "wma") -> DataFrame:
    """Weights 1..n, the newest bar weighs most."""
    total = sum(((n - k) * (F.col("close") if k == 0 else before("close", k)) for k in range(n)), F.lit(0.0))
    return bars.withColumn(out, total / F.lit(n * (n + 1) / 2))


def ema(bars: DataFrame, n: int = 20, guarded: bool = True, adjust: bool = False, out: str = "ema") -> DataFrame:
    made = with_ema(bars, (out, "close", span(n)), adjust=adjust)
    return made.withColumn(out, F.when(history() >= n, F.col(out))) if guarded else made


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, guarded: bool = True) -> DataFrame:
    lines = with_ema(placed(bars, *BY_SYMBOL), ("__f", "close", span(fast)), ("__s", "close", span(slow))).withColumn("macd", F.col("__f") - F.col("__s")).drop("__f", "__s")
    made = with_ema(lines, ("macd_signal", "macd", span(signal))).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    made = made if AT in bars.columns else made.drop(AT)
    if guarded:
        enough = history() >= slow
        made = made.withColumns({c: F.when(enough, F.col(c)) for c in ("macd", "macd_signal", "macd_hist")})
    return made


def rsi_value(gain: Column, loss: Column) -> Column:
    """100 - 100 / (1 + gain / loss); 100 without loss, null without either."""
    return F.when(loss == 0, F.when(gain > 0, F.lit(100.0))).otherwise(100.0 - 100.0 / (1.0 + gain / loss))


def _moves(bars: DataFrame) -> DataFrame:
    move = F.col("close") - before("close")
    return bars.withColumn("__g", F.greatest(move, F.lit(0.0))).withColumn("__l", F.greatest(-move, F.lit(0.0))).withColumns(
        {"__g": F.when(move.isNotNull(), F.col("__g")), "__l": F.when(move.isNotNull(), F.col("__l"))}
    )


def rsi_sma(bars: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """Plain means of gains and losses over full windows of n moves."""
    g, l = (full(n, F.avg(c).over(roll(n)), c) for c in ("__g", "__l"))
    return _moves(bars).withColumn("__ag", g).withColumn("__al", l).withColumn(out, rsi_value(F.col("__ag"), F.col("__al"))).drop("__g", "__l", "__ag", "__al")


def rsi_wilder(bars: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """Means with a = 1/n, seeded by the first move; first value at row n, null below n + 1 rows."""
    made = with_ema(_moves(bars), ("__ag", "__g", 1.0 / n), ("__al", "__l", 1.0 / n))
    enough = (F.row_number().over(ordered()) > n) & (history() > n)
    return made.withColumn(out, F.when(enough, rsi_value(F.col("__ag"), F.col("__al")))).drop("__g", "__l", "__ag", "__al")


def rsi_span(bars: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """Means with a = 2/(n + 1), the first row counting as no move."""
    moved = _moves(bars).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("__g", "__l")})
    made = with_ema(moved, ("__ag", "__g", span(n)), ("__al", "__l", span(n)))
    return made.withColumn(out, rsi_value(F.col("__ag"), F.col("__al"))).drop("__g", "__l", "__ag", "__al")


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, partial: bool = False) -> DataFrame:
    """boll_mid, boll_upper, boll_lower with the sample standard deviation."""
    mid, dev = F.avg("close").over(roll(n)), F.stddev_samp("close").over(roll(n))
    mid, dev = (mid, dev) if partial else (full(n, mid), full(n, dev))
    made = bars.withColumn("boll_mid", mid).withColumn("__dev", dev)
    return made.withColumn("boll_upper", F.col("boll_mid") + k * F.col("__dev")).withColumn("boll_lower", F.col("boll_mid") - k * F.col("__dev")).drop("__dev")


def bandwidth(bars: DataFrame) -> DataFrame:
    return bars.withColumn("boll_bandwidth", F.try_divide(F.col("boll_upper") - F.col("boll_lower"), "boll_mid"))


def percent_b(bars: DataFrame) -> DataFrame:
    return bars.withColumn("boll_pct_b", F.try_divide(F.col("close") - F.col("boll_lower"), F.col("boll_upper") - F.col("boll_lower")))


def kdj(bars: DataFrame, n: int = 9, m1: int = 3, m2: int = 3) -> DataFrame:
    """k, d, j; the raw value is 50 where the range is zero."""
    hi, lo = F.max("high").over(roll(n)), F.min("low").over(roll(n))
    raw = full(n, F.when(hi == lo, F.lit(50.0)).otherwise((F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100.0), "high")
    made = with_ema(with_ema(placed(bars.withColumn("__rsv", raw), *BY_SYMBOL), ("k", "__rsv", 1.0 / m1)), ("d", "k", 1.0 / m2))
    return made.withColumn("j", 3.0 * F.col("k") - 2.0 * F.col("d")).drop("__rsv", *([] if AT in bars.columns else [AT]))


def stochastic(bars: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    hi, lo = F.max("high").over(roll(n)), F.min("low").over(roll(n))
    made = bars.withColumn("stoch_k", full(n, F.try_divide(100.0 * (F.col("close") - lo), hi - lo), "high"))
    return made.withColumn("stoch_d", full(d, F.avg("stoch_k").over(roll(d)), "stoch_k"))


def williams_r(bars: DataFrame, n: int = 14) -> DataFrame:
    hi, lo = F.max("high").over(roll(n)), F.min("low").over(roll(n))
    return bars.withColumn("williams_r", full(n, F.try_divide(-100.0 * (hi - F.col("close")), hi - lo), "high"))


def true_range() -> Column:
    """Largest of high - low and the gaps from the previous close; the first bar has no gap."""
    prev = before("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr_sma(bars: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    made = bars.withColumn("__tr", true_range())
    return made.withColumn(out, full(n, F.avg("__tr").over(roll(n)), "__tr")).drop("__tr")


def atr_ema(bars: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    return with_ema(bars.withColumn("__tr", true_range()), (out, "__tr", span(n))).drop("__tr")


def keltner(bars: DataFrame, n: int = 20, atr: int = 10, k: float = 2.0) -> DataFrame:
    made = with_ema(bars.withColumn("__tr", true_range()), ("kelt_mid", "close", span(n)), ("__atr", "__tr", span(atr)))
    return made.withColumn("kelt_upper", F.col("kelt_mid") + k * F.col("__atr")).withColumn("kelt_lower", F.col("kelt_mid") - k * F.col("__atr")).drop("__tr", "__atr")


def donchian(bars: DataFrame, n: int = 20, m: int = 10) -> DataFrame:
    made = bars.withColumn("don_upper", full(n, F.max("high").over(roll(n)), "high")).withColumn("don_lower", full(m, F.min("low").over(roll(m)), "low"))
    return made.withColumn("don_mid", (F.col("don_upper") + F.col("don_lower")) / 2.0)


def zscore(bars: DataFrame, n: int = 20, out: str = "zscore") -> DataFrame:
    mean, dev = F.avg("close").over(roll(n)), F.stddev_samp("close").over(roll(n))
    return bars.withColumn(out, full(n, F.try_divide(F.col("close") - mean, dev)))


def breakout(bars: DataFrame, n: int = 20, m: int = 10) -> DataFrame:
    """close above the highest high of the n bars before, or below the lowest low of the m before."""
    made = donchian(bars, n, m)
    up = F.coalesce(F.col("close") > before("don_upper"), F.lit(False))
    down = F.coalesce(F.col("close") < before("don_lower"), F.lit(False))
    return made.withColumn("breakout_up", up).withColumn("breakout_down", down)


def crossover(bars: DataFrame, a: str, b: str, out: str = "crossover") -> DataFrame:
    return bars.withColumn(out, crossed_up(F.col(a), F.col(b), before(a), before(b)))


def crossunder(bars: DataFrame, a: str, b: str, out: str = "crossunder") -> DataFrame:
    return bars.withColumn(out, crossed_down(F.col(a), F.col(b), before(a), before(b)))


def above(col: Column, value: float) -> Column:
    return F.coalesce(col > value, F.lit(False))


def below(col: Column, value: float) -> Column:
    return F.coalesce(col < value, F.lit(False))


def returns(bars: DataFrame, out: str = "ret") -> DataFrame:
    return bars.withColumn(out, F.try_divide(F.col("close"), before("close")) - 1.0)
