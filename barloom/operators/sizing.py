"""Backtests in whole shares: a state machine over each symbol's signals.

Whole shares make the cash after a trade depend on the cash before it, so no window
gives it. Only bars with a signal can change the state; they are put in order by symbol
and folded, one after another, by a Catalyst aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import BY_SYMBOL
from barloom.operators.backtest import CASH, COMMISSION

#: Share of the cash that a position may take.
STAKE = 0.95
TRADE = "entry_ts {ts}, exit_ts {ts}, shares bigint, entry_price double, exit_price double, pnl double, cash_after double"


def _run(events: Column, ts: str, cash: float, stake: float, commission: float) -> Column:
    """State (cash, shares, price, ts, trades) after the signals in order."""
    start = F.struct(
        F.lit(float(cash)).alias("cash"), F.lit(0).cast("bigint").alias("shares"), F.lit(None).cast("double").alias("price"), F.lit(None).cast(ts).alias("ts"),
        F.array().cast(f"array<struct<{TRADE.format(ts=ts).replace(' ', ':').replace(',:', ',')}>>").alias("trades"),
    )

    def step(s: Column, e: Column) -> Column:
        size = F.floor(s["cash"] * stake / e["close"]).cast("bigint")
        opens = (s["shares"] == 0) & (e["signal"] == 1) & (size > 0)
        closes = (s["shares"] > 0) & (e["signal"] == -1)
        got = s["cash"] + s["shares"] * e["close"] * (1.0 - commission)
        pnl = (e["close"] - s["price"]) * s["shares"] - commission * (s["shares"] * s["price"]) - commission * (s["shares"] * e["close"])
        trade = F.struct(s["ts"].alias("entry_ts"), e["ts"].alias("exit_ts"), s["shares"].alias("shares"), s["price"].alias("entry_price"), e["close"].alias("exit_price"), pnl.alias("pnl"), got.alias("cash_after"))
        state = lambda cash, shares, price, at, trades: F.struct(cash.alias("cash"), shares.alias("shares"), price.alias("price"), at.alias("ts"), trades.alias("trades"))
        return (
            F.when(opens, state(s["cash"] - size * e["close"] * (1.0 + commission), size, e["close"], e["ts"], s["trades"]))
            .when(closes, state(got, F.lit(0).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast(ts), F.concat(s["trades"], F.array(trade))))
            .otherwise(s)
        )

    return F.aggregate(events, start, step)


def _states(signalled: DataFrame, cash: float, stake: float, commission: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, last, n_bars, run): the last close, the number of bars and the state at the end."""
    ts = signalled.schema["bar_ts"].dataType.simpleString()
    event = F.struct(F.col("bar_ts").alias("ts"), F.col("close").cast("double").alias("close"), F.col("signal").cast("int").alias("signal"))
    # Prices must be positive; a bar without one can't be traded at.
    told = F.when((F.col("signal") != 0) & (F.col("close") > 0), event)
    grouped = signalled.groupBy(*keys).agg(F.array_sort(F.collect_list(told)).alias("events"), F.max_by("close", "bar_ts").alias("last"), F.count(F.lit(1)).alias("n_bars"))
    return grouped.select(*keys, "last", "n_bars", _run(F.col("events"), ts, cash, stake, commission).alias("run"))


def sized_trades(signalled: DataFrame, cash: float = CASH, stake: float = STAKE, commission: float = COMMISSION, keys: tuple[str, ...] = BY_SYMBOL) -> DataFrame:
    """One row for each closed trade of int(cash * stake / close) shares, filled at the signal's close.

    A buy that can't pay for one share opens nothing; a later one may. An open position
    is not closed at the end.
    """
    made = _states(signalled, cash, stake, commission, keys).select(*keys, F.explode("run.trades").alias("t"))
    return made.select(*keys, "t.*")


def sized_results(signalled: DataFrame, cash: float = CASH, stake: float = STAKE, commission: float = COMMISSION, keys: tuple[str, ...] = BY_SYMBOL) -> DataFrame:
    """(keys, n_bars, total_trades, cash, shares, value, total_return, win_rate): what each symbol ends with."""
    made = _states(signalled, cash, stake, commission, keys)
    value = F.col("run.cash") + F.when(F.col("run.shares") > 0, F.col("run.shares") * F.col("last")).otherwise(F.lit(0.0))
    won = F.size(F.filter("run.trades", lambda t: t["pnl"] > 0))
    n = F.size("run.trades")
    return made.select(
        *keys, "n_bars", n.cast("long").alias("total_trades"), F.col("run.cash").alias("cash"), F.col("run.shares").alias("shares"), value.alias("value"),
        (value / F.lit(float(cash)) - 1.0).alias("total_return"), F.coalesce(F.try_divide(won, n), F.lit(0.0)).alias("win_rate"),
    )
