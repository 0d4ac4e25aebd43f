"""Trading signals: bars with a column ``signal`` of 1 (buy), -1 (sell) or 0.

Where both sides hold on a bar, the sale wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import before, crossed_down, crossed_up, full, roll, span, with_ema
from barloom.operators import indicators as ind


def _signal(bars: DataFrame, buy: Column, sell: Column) -> DataFrame:
    return bars.withColumn("signal", F.when(sell, F.lit(-1)).when(buy, F.lit(1)).otherwise(F.lit(0)))


def momentum_breakout(bars: DataFrame, entry_period: int = 20, exit_period: int = 10, atr_period: int = 14, stop_loss_atr: float = 2.0) -> DataFrame:
    made = ind.atr_sma(ind.breakout(bars, entry_period, exit_period), atr_period).withColumn("stop_loss_distance", F.col("atr") * stop_loss_atr)
    return _signal(made, F.col("breakout_up"), F.col("breakout_down"))


def dual_ma_crossover(bars: DataFrame, fast_period: int = 10, slow_period: int = 30, ma_type: str = "ema") -> DataFrame:
    if ma_type == "ema":
        made = with_ema(bars, ("ma_fast", "close", span(fast_period)), ("ma_slow", "close", span(slow_period)))
    else:
        made = ind.sma(ind.sma(bars, fast_period, out="ma_fast"), slow_period, out="ma_slow")
    sides = F.col("ma_fast"), F.col("ma_slow"), before("ma_fast"), before("ma_slow")
    return _signal(made, crossed_up(*sides), crossed_down(*sides))


def bollinger_rsi(bars: DataFrame, bb_period: int = 20, bb_std: float = 2.0, rsi_period: int = 14, rsi_oversold: float = 30.0, rsi_overbought: float = 70.0) -> DataFrame:
    made = ind.rsi_sma(ind.bollinger(bars, bb_period, bb_std), rsi_period)
    buy = (F.col("close") <= F.col("boll_lower")) & (F.col("rsi") < rsi_oversold)
    sell = (F.col("close") >= F.col("boll_upper")) & (F.col("rsi") > rsi_overbought)
    return _signal(made, buy, sell)


def rsi_extreme(bars: DataFrame, rsi_period: int = 14, oversold: float = 30.0, overbought: float = 70.0) -> DataFrame:
    made = ind.rsi_sma(bars, rsi_period)
    return _signal(made, F.col("rsi") < oversold, F.col("rsi") > overbought)


def macd_signal(bars: DataFrame, fast_period: int = 12, slow_period: int = 26, signal_period: int = 9, above_zero_only: bool = True) -> DataFrame:
    made = ind.macd(bars, fast_period, slow_period, signal_period, guarded=False)
    sides = F.col("macd"), F.col("macd_signal"), before("macd"), before("macd_signal")
    buy, sell = crossed_up(*sides), crossed_down(*sides)
    if above_zero_only:
        buy, sell = buy & (F.col("macd") > 0), sell & (F.col("macd") < 0)
    return _signal(made, buy, sell)


def mean_reversion(bars: DataFrame, lookback: int = 20, entry_std: float = 2.0, atr_period: int = 14, atr_stop: float = 2.0) -> DataFrame:
    made = ind.atr_sma(ind.zscore(bars, lookback), atr_period).withColumn("stop_loss_distance", F.col("atr") * atr_stop)
    return _signal(made, F.col("zscore") < -entry_std, F.col("zscore") > entry_std)


def turtle_trading(bars: DataFrame, entry_period: int = 20, exit_period: int = 10, atr_period: int = 20, risk_per_trade: float = 0.01, stop_loss_atr: float = 2.0) -> DataFrame:
    made = momentum_breakout(bars, entry_period, exit_period, atr_period, stop_loss_atr)
    return made.withColumn("position_size", F.try_divide(F.lit(risk_per_trade), F.try_divide("stop_loss_distance", "close")))


def dual_thrust(bars: DataFrame, lookback: int = 4, k1: float = 0.5, k2: float = 0.5) -> DataFrame:
    """Triggers around the open by a share of the range, which includes the current bar; needs lookback + 1 rows."""
    over = roll(lookback)
    reach = F.greatest(F.max("high").over(over) - F.min("close").over(over), F.max("close").over(over) - F.min("low").over(over))
    made = bars.withColumn("reach", full(lookback + 1, reach))
    buy = F.col("close") > F.col("open") + k1 * F.col("reach")
    sell = F.col("close") < F.col("open") - k2 * F.col("reach")
    return _signal(made, buy, sell)


def bollinger_bounce(bars: DataFrame, period: int = 20, devfactor: float = 2.0) -> DataFrame:
    made = ind.bollinger(bars, period, devfactor)
    return _signal(made, F.col("close") < F.col("boll_lower"), F.col("close") > F.col("boll_upper"))


TEMPLATES: dict[str, Callable[..., DataFrame]] = {
    "bollinger_bounce": bollinger_bounce,
    "bollinger_rsi": bollinger_rsi,
    "dual_ma_crossover": dual_ma_crossover,
    "dual_thrust": dual_thrust,
    "macd_signal": macd_signal,
    "mean_reversion": mean_reversion,
    "momentum_breakout": momentum_breakout,
    "rsi_extreme": rsi_extreme,
    "turtle_trading": turtle_trading,
}


def for_query(names: list[str], text: str = "") -> tuple[str, dict[str, float]]:
    """Template and parameters for the indicators of a query: MACD before RSI before bands before averages.

    Numbers in the text below 50 set RSI's lower limit, others the upper one.
    """
    import re

    have = {n.lower() for n in names}
    if "macd" in have:
        return "macd_signal", {}
    if "rsi" in have:
        numbers = [float(x) for x in re.findall(r"\d+", text) if float(x) <= 100]
        low, high = [x for x in numbers if x < 50], [x for x in numbers if x >= 50]
        return "rsi_extreme", {**({"oversold": low[-1]} if low else {}), **({"overbought": high[-1]} if high else {})}
    if have & {"boll", "bollinger"}:
        return "bollinger_bounce", {}
    return "dual_ma_crossover", {"ma_type": "sma"}
