"""Whole-share backtests against a plain loop, and zeros for short histories."""

import datetime as dt
import random

import pytest

from barloom.operators import metrics, sizing

DAY = dt.datetime(2024, 1, 1)


def plain(rows, cash=1000.0, stake=0.95, fee=0.001):
    shares, price, at, trades = 0, None, None, []
    for ts, close, signal in sorted(rows):
        if signal == 1 and not shares:
            size = int(cash * stake / close)
            if size > 0:
                shares, price, at = size, close, ts
                cash -= size * close * (1.0 + fee)
        elif signal == -1 and shares:
            cash += shares * close * (1.0 - fee)
            trades.append((at, ts, shares, price, close, (close - price) * shares - fee * shares * price - fee * shares * close, cash))
            shares, price, at = 0, None, None
    return trades, cash, shares


def test_against_a_loop(spark):
    rng = random.Random(4)
    rows = {s: [(DAY + dt.timedelta(days=k), round(rng.uniform(5, top), 2), rng.choice([0, 0, 1, -1])) for k in range(200)] for s, top in (("a", 50), ("b", 3000), ("c", 900))}
    rows["d"] = [(DAY, 10.0, 0)]  # no signal
    bars = spark.createDataFrame([(s, t, c, g) for s, found in rows.items() for t, c, g in found], "symbol string, bar_ts timestamp_ntz, close double, signal int").repartition(4)
    got = {}
    for r in sizing.sized_trades(bars, cash=1000.0).orderBy("symbol", "exit_ts").collect():
        got.setdefault(r.symbol, []).append(tuple(r)[1:])
    ends = {r.symbol: r for r in sizing.sized_results(bars, cash=1000.0).collect()}
    for s, found in rows.items():
        trades, cash, shares = plain(found)
        assert len(got.get(s, [])) == len(trades) == ends[s].total_trades
        for mine, want in zip(got.get(s, []), trades):
            assert mine[:3] == want[:3] and mine[3:] == pytest.approx(want[3:])
        last = max(found)[1]
        assert (ends[s].shares, ends[s].n_bars) == (shares, len(found)) and ends[s].value == pytest.approx(cash + shares * last)
    assert len(got["a"]) > 20 and ends["d"].total_return == 0
    assert any(c > 1000 and g == 1 for _, c, g in rows["b"])  # some buys can't pay for one share


def test_short_histories_have_zeros(spark):
    rows = [(s, DAY + dt.timedelta(days=k), 10.0 + k % 7, (1, 0, 0, -1)[k % 4]) for s, n in (("short", 49), ("long", 50)) for k in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, close double, signal int")
    got = {r.symbol: r for r in metrics.strategy_results(bars).collect()}
    assert tuple(got["short"])[1:] == (49, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0)
    assert got["long"].n_bars == 50 and got["long"].total_trades > 5 and got["long"].total_return != 0
