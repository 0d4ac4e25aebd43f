"""Search over templates: each combination's signals are those of the template by itself; indicators are made once."""

import datetime as dt
import random

import pytest

from barloom.operators import search, signals


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(7)
    rows = []
    for s in ("a", "b"):
        price = 50.0
        for k in range(150):
            price = max(5.0, price + rng.uniform(-3, 3))
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), price, price + 1, price - 1, price + rng.uniform(-1, 1), 100))
    return spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume long").repartition(3)


def test_signals_are_those_of_the_templates(spark, bars):
    tried = [("sma_cross", {"fast": 5, "slow": 20}), ("ema_cross", {"fast": 5, "slow": 20}), ("rsi", {"n": 14, "low": 40.0, "high": 60.0}), ("bands", {"n": 20, "k": 1.0}), ("breakout", {"n": 20, "m": 10}), ("bands", {"n": 20, "k": 2.0})]
    alone = [
        signals.dual_ma_crossover(bars, 5, 20, "sma"), signals.dual_ma_crossover(bars, 5, 20), signals.rsi_extreme(bars, 14, 40.0, 60.0),
        signals.bollinger_bounce(bars, 20, 1.0), signals.momentum_breakout(bars, 20, 10), signals.bollinger_bounce(bars, 20, 2.0),
    ]
    made = {}
    for r in search.signals_of(bars, tried).collect():
        made.setdefault(r.param_id, {})[r.symbol, r.bar_ts] = r.signal
    for i, df in enumerate(alone):
        want = {(r.symbol, r.bar_ts): r.signal for r in df.select("symbol", "bar_ts", "signal").collect()}
        assert made[i] == want and set(want.values()) != {0}
    assert {r.template for r in search.search(bars, tried).collect()} == {t for t, _ in tried}


def test_indicators_are_made_once(bars):
    tried = [("bands", {"n": 20, "k": k / 4}) for k in range(1, 9)] + [("sma_cross", {"fast": f, "slow": 20}) for f in (5, 8, 10)]
    needs = {n for t, p in tried for n in search.TEMPLATES[t].needs(**p)}
    columns = search.with_indicators(bars, needs).columns
    assert len(columns) == len(set(columns)) and sum(c.startswith("__sma") for c in columns) == 4 and sum(c.startswith("__dev") for c in columns) == 1


def test_unknown_templates_raise(bars):
    with pytest.raises(ValueError):
        search.signals_of(bars, [("nosuch", {})])
