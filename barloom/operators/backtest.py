"""All-in, all-out backtests over a signal column, by running values over blocks of bars.

A buy while flat puts all cash in at the bar's close, a sale while long takes all
out; each side costs a commission. The position after a bar follows from the last
signal that isn't zero, so no loop is needed. An open position stays open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scan import Running, placed, running
from barloom.functions.shared import cut_lineage
from barloom.functions.windows import BY_SYMBOL

CASH, COMMISSION = 100_000.0, 0.001


def positions(signalled: DataFrame, *keys: str) -> DataFrame:
    """Adds holding (after the bar), entry, exit, n_bars (so far), and entry_price, entry_ts and entry_bar of the position held before the bar's exit."""
    keys = keys or BY_SYMBOL
    said = F.nullif("signal", F.lit(0))
    made = running(placed(signalled, *keys), keys, __said=Running("last", said), __was=Running("last", said, now=False), n_bars=Running("count", F.lit(1)))
    held, was = (F.coalesce(c, F.lit(-1)) == 1 for c in ("__said", "__was"))
    made = made.withColumns({"holding": held, "entry": held & ~was, "exit": ~held & was}).drop("__said", "__was")
    opened = {n: Running("last", F.when(F.col("entry"), F.col(c))) for n, c in (("entry_price", "close"), ("entry_ts", "bar_ts"), ("entry_bar", "n_bars"))}
    return running(made, keys, **opened)


def equity(signalled: DataFrame, cash: float = CASH, commission: float = COMMISSION, *keys: str) -> DataFrame:
    """Adds log_equity, the natural logarithm of cash plus holdings; prices must be positive."""
    keys = keys or BY_SYMBOL
    side = F.ln(F.lit(1.0 - commission))
    gain = F.when(F.col("exit"), 2 * side + F.ln("close") - F.ln("entry_price")).otherwise(F.lit(0.0))
    made = running(positions(signalled, *keys), keys, __gain=Running("sum", gain))
    closed = F.ln(F.lit(cash).cast("double")) + F.col("__gain")
    return made.withColumn("log_equity", F.when(F.col("holding"), closed + side + F.ln("close") - F.ln("entry_price")).otherwise(closed)).drop("__gain")


def valued(signalled: DataFrame, cash: float = CASH, commission: float = COMMISSION, *keys: str) -> DataFrame:
    """Positions with log_equity, its value at the bar before (prev_equity) and drawdown; written once, as several results are made of it."""
    keys = keys or BY_SYMBOL
    made = running(equity(signalled, cash, commission, *keys), keys, __top=Running("max", "log_equity"), prev_equity=Running("before", "log_equity"))
    return cut_lineage(made.withColumn("drawdown", F.exp(F.col("log_equity") - F.col("__top")) - 1.0).drop("__top"))


def trades(signalled: DataFrame, commission: float = COMMISSION, *keys: str) -> DataFrame:
    """One row for each closed trade: times, prices, return_pct (after both commissions) and bars held.

    A frame that has its positions already, such as :func:`equity` gives, isn't given them again.
    """
    keys = keys or BY_SYMBOL
    made = (signalled if "entry_bar" in signalled.columns else positions(signalled, *keys)).where("exit")
    pct = ((F.col("close") - F.col("entry_price")) / F.col("entry_price") - 2 * commission) * 100.0
    held = (F.col("n_bars") - F.col("entry_bar")).cast("long").alias("bars_held")
    return made.select(*keys, "entry_ts", F.col("bar_ts").alias("exit_ts"), "entry_price", F.col("close").alias("exit_price"), pct.alias("return_pct"), held)


def drawdown(valued: DataFrame, *keys: str) -> DataFrame:
    """Adds drawdown, the loss from the highest value so far, at most 0; from log_equity."""
    keys = keys or BY_SYMBOL
    made = running(placed(valued, *keys), keys, __top=Running("max", "log_equity"))
    return made.withColumn("drawdown", F.exp(F.col("log_equity") - F.col("__top")) - 1.0).drop("__top")


def drawdown_runs(drawn: DataFrame, *keys: str) -> DataFrame:
    """Longest run of bars below the highest value, for each symbol."""
    keys = keys or BY_SYMBOL
    down = F.col("drawdown") < 0
    islands = running(placed(drawn, *keys), keys, __i=Running("sum", F.when(down, 0).otherwise(1)))
    runs = islands.groupBy(*keys, "__i").agg(F.sum(F.when(down, 1).otherwise(0)).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").cast("long").alias("max_drawdown_bars"))
