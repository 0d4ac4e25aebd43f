import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.windows import with_ema
from barloom.operators import backtest, indicators as ind, metrics, optimise, patterns, signals
from barloom.plans import screen
from barloom.sources import bars as source

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume bigint"


def series(spark, **closes):
    rows = [(s, DAY + dt.timedelta(days=i), c * 0.99, c * 1.01, c * 0.98, c, 100) for s, cs in closes.items() for i, c in enumerate(map(float, cs))]
    return spark.createDataFrame(rows, SCHEMA)


def candles(spark, *rows):
    return spark.createDataFrame([("A", DAY + dt.timedelta(days=i), *map(float, r), 1) for i, r in enumerate(rows)], SCHEMA)


def column(df, name, symbol=None):
    df = df if symbol is None else df.where(F.col("symbol") == symbol)
    return [r[name] for r in df.orderBy("symbol", "bar_ts").collect()]


def test_sma_values(spark):
    small = series(spark, A=range(1, 21), S=[10, 11, 12, 13, 14, 15, 14, 13, 12, 11], T=[1, 2])
    five = column(ind.sma(small, 5), "sma", "A")
    assert five[:4] == [None] * 4 and five[4] == 3.0 and five[5] == 4.0
    assert column(ind.sma(small, 10), "sma", "S")[-1] == 12.5
    assert column(ind.sma(small, 5), "sma", "T") == [None, None] and column(ind.sma(small, 5, partial=True), "sma", "T") == [1.0, 1.5]


def test_ema_family_is_pandas(spark):
    rng = np.random.default_rng(0)
    close = pd.Series(100 + rng.normal(size=80).cumsum())
    b = series(spark, A=close, B=[1.0, 2.0])
    assert np.allclose(column(ind.ema(b, 20), "ema", "A"), close.ewm(span=20, adjust=False).mean())
    assert column(ind.ema(b, 20), "ema", "B") == [None, None]
    assert np.allclose(column(ind.ema(b, 20, guarded=False, adjust=True), "ema", "A"), close.ewm(span=20, adjust=True).mean())
    fast, slow = (close.ewm(span=n, adjust=False).mean() for n in (12, 26))
    assert np.allclose(column(ind.macd(b), "macd_signal", "A"), (fast - slow).ewm(span=9, adjust=False).mean())
    d = close.diff()
    g, l = (x.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for x in (d, -d))
    made = column(ind.rsi_wilder(b), "rsi", "A")
    assert made[:14] == [None] * 14 and np.allclose(made[14:], (100 - 100 / (1 + g / l))[14:])


def test_rsi_extremes(spark):
    b = series(spark, UP=range(1, 30), FLAT=[50] * 29, DOWN=range(30, 1, -1))
    for f in (ind.rsi_wilder, ind.rsi_sma, ind.rsi_span):
        got = f(b)
        assert column(got, "rsi", "UP")[-1] == 100.0 and column(got, "rsi", "FLAT")[-1] is None and column(got, "rsi", "DOWN")[-1] == 0.0


def test_crossings(spark):
    rows = [("A", DAY + dt.timedelta(days=i), 1.0 if i < 8 else 5.0, 3.0) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, a double, b double")
    assert [i for i, x in enumerate(column(ind.crossover(df, "a", "b"), "crossover")) if x] == [8]
    assert [i for i, x in enumerate(column(ind.crossunder(df, "b", "a"), "crossunder")) if x] == [8]
    one = df.select(ind.above(F.col("b"), 3.0).alias("x"), ind.below(F.col("b"), 3.0).alias("y")).first()
    assert not one.x and not one.y


def test_flat_ranges_give_null_or_fifty(spark):
    flat = candles(spark, *[(5, 5, 5, 5)] * 25)
    assert column(ind.kdj(flat), "k")[-1] == 50.0
    for f, name in ((ind.stochastic, "stoch_k"), (ind.williams_r, "williams_r"), (ind.zscore, "zscore"), (lambda b: ind.percent_b(ind.bollinger(b)), "boll_pct_b")):
        assert column(f(flat), name)[-1] is None


@pytest.mark.parametrize(
    ("name", "rows"),
    [
        ("bullish_engulfing", [(10, 11, 8, 9), (8.5, 11, 8, 10.5)]),
        ("bearish_engulfing", [(9, 11, 8, 10), (10.5, 11, 8, 8.5)]),
        ("doji", [(10, 11, 9, 10.05)]),
        ("hammer", [(10, 10.3, 8, 10.3)]),
        ("morning_star", [(12, 12.1, 9.9, 10), (9, 9.6, 8.9, 9.1), (9.5, 11.6, 9.4, 11.5)]),
        ("evening_star", [(10, 12.1, 9.9, 12), (13, 13.6, 12.9, 13.1), (12.5, 12.6, 10.4, 10.5)]),
        ("three_white_soldiers", [(10, 12, 9, 11), (10.5, 13, 10, 12), (11.5, 14, 11, 13)]),
        ("three_black_crows", [(13, 14, 11, 12), (12.5, 13, 10, 11), (11.5, 12, 9, 10)]),
    ],
)
def test_patterns(spark, name, rows):
    made = column(patterns.scan(candles(spark, *rows)), name)
    assert made[-1] is True and not any(made[:-1])
    flat = patterns.scan(candles(spark, *[(5, 5, 5, 5)] * 4))
    assert not any(column(flat, name))


def loop(bars, cash=100_000.0, c=0.001):
    """The rule of the backtest, bar by bar."""
    shares, entry, equity, done = 0.0, None, [], []
    for price, s in bars:
        if s == 1 and shares == 0:
            shares, cash, entry = cash * (1 - c) / price, 0.0, price
        elif s == -1 and shares > 0:
            cash, shares = shares * price * (1 - c), 0.0
            done.append(((price - entry) / entry - 2 * c) * 100)
        equity.append(cash + shares * price)
    return equity, done


def test_backtest_is_the_loop(spark):
    rng = np.random.default_rng(1)
    b = series(spark, A=100 * np.exp(rng.normal(0, 0.02, 300).cumsum()), B=[5.0] * 30)
    signalled = signals.rsi_extreme(b, oversold=45, overbought=55)
    rows = [(r.close, r.signal) for r in signalled.where("symbol = 'A'").orderBy("bar_ts").collect()]
    equity, done = loop(rows)
    assert len(done) > 5
    assert np.allclose(np.exp(column(backtest.equity(signalled), "log_equity", "A")), equity)
    assert np.allclose([r.return_pct for r in backtest.trades(signalled).orderBy("exit_ts").collect()], done)
    got = {r.symbol: r for r in metrics.backtest_metrics(signalled).collect()}
    e = pd.Series(equity)
    assert math.isclose(got["A"].total_return, e.iloc[-1] / 100_000 - 1, rel_tol=1e-9)
    assert math.isclose(got["A"].max_drawdown, -((e - e.cummax()) / e.cummax()).min(), rel_tol=1e-9)
    assert got["A"].total_trades == len(done) and got["A"].win_rate == pytest.approx(np.mean([x > 0 for x in done]))
    assert got["B"].total_trades == 0 and got["B"].total_return == pytest.approx(0) and got["B"].profit_factor is None


def test_every_template_runs(spark):
    rng = np.random.default_rng(2)
    b = series(spark, A=100 + rng.normal(size=120).cumsum())
    for build in signals.TEMPLATES.values():
        assert {*column(build(b), "signal")} <= {-1, 0, 1}
    assert signals.for_query(["RSI"], "rsi under 25 and over 80") == ("rsi_extreme", {"oversold": 25.0, "overbought": 80.0})
    assert signals.for_query(["ma", "macd"])[0] == "macd_signal" and signals.for_query([])[0] == "dual_ma_crossover"


def test_ratings(spark):
    rows = [("excellent", 1.5, 0.45, 2.5, 0.03, 0.65, 100), ("mediocre", 0.15, 0.08, 0.6, 0.18, 0.42, 80), ("poor", -0.2, -0.1, -0.5, 0.45, 0.25, 50), ("none", None, None, None, None, None, 0)]
    df = spark.createDataFrame(rows, "symbol string, total_return double, annual_return double, sharpe_ratio double, max_drawdown double, win_rate double, total_trades long")
    got = {r.symbol: r for r in metrics.rated(df).collect()}
    assert got["excellent"].overall_score == 100.0 and got["mediocre"].overall_score == 50.0 and got["poor"].overall_score == 0.0
    assert got["none"].rating_sharpe_ratio == "critical" and got["none"].few_trades
    assert len(got["poor"].risk_warnings) == 4 and got["excellent"].weaknesses == []
    best = metrics.compare_best(metrics.rated(df)).first()
    assert best.best == "excellent"
    wide = metrics.side_by_side(df, ["excellent", "poor"]).where("metric = 'win_rate'").first()
    assert (wide.excellent, wide.poor) == (0.65, 0.25)
    score = spark.range(1).select(metrics.percent_score(F.lit(1.8), F.lit(22.0), F.lit(8.0), F.lit(62.0)).alias("s"), metrics.percent_score(F.lit(None).cast("double"), F.lit(22.0), F.lit(8.0), F.lit(62.0)).alias("n")).first()
    assert score.s == 78.7 and score.n is None


def test_grid_and_ties(spark):
    assert optimise.grid() == [{}] and len(optimise.grid(a=[1, 2], b=[3, 4, 5])) == 6
    scores = spark.createDataFrame([("A", 0, 0.1), ("A", 1, 0.27), ("A", 2, 0.27)], "symbol string, param_id int, score double")
    assert optimise.best_of(scores).first().param_id == 1
    assert optimise.random_combinations({"a": [1, 9], "b": [1, 2, 3]}, 3) == optimise.random_combinations({"a": [1, 9], "b": [1, 2, 3]}, 3)


def test_folds(spark):
    b = series(spark, A=range(1, 721), T=range(1, 40))
    rows = optimise.folds(b).groupBy("symbol", "fold", "part").count().collect()
    got = {(r.symbol, r.fold, r.part): r["count"] for r in rows}
    assert not [k for k in got if k[0] == "T"]
    total = int((720 // 5) / (1 - 0.7))
    assert total == 479
    for f in range(5):
        start = f * 144
        cut, end = min(start + int(total * 0.7), 720), min(start + total, 720)
        if cut - start >= 30 and end - cut >= 10:
            assert got["A", f, "train"] == cut - start and got["A", f, "test"] == end - cut
        else:
            assert ("A", f, "train") not in got


def test_screen_truths(spark):
    b = series(spark, RISING=[50 + 0.5 * i for i in range(60)], FALLING=[150 - 0.5 * i for i in range(60)], SHORT=[1, 2, 3])
    run = lambda *c: {r.symbol: r for r in screen.run(screen.Screen(c), b).collect()}
    got = run(screen.Condition("RSI", "above", 70.0), screen.Condition("MA", "above", params={"period": 10}))
    assert got["RISING"].matched and not got["FALLING"].matched and got["SHORT"].explanation == "Insufficient data."
    assert got["RISING"].indicators["rsi_14.rsi"] == 100.0
    assert all(r.matched for r in run().values())
    assert not any(r.matched for r in run(screen.Condition("RSI", "above")).values())
    assert not any(r.matched for r in run(screen.Condition("VWAP", "above", 1.0)).values())
    assert run(screen.Condition("PRICE", "below", 125.0))["FALLING"].matched
    with pytest.raises(ValueError):
        screen.Condition("RSI", "near", 1.0)


def test_phrases():
    p = screen.parse("RSI below 30 and MACD golden cross, price above 20 in the last 90 days")
    assert [(c.name, c.comparison, c.value) for c in p.conditions] == [("RSI", "below", 30.0), ("MACD", "crossover", None), ("PRICE", "above", 20.0)] and p.days == 90
    p = screen.parse("RSI低于30，MACD金叉")
    assert [(c.name, c.comparison, c.value) for c in p.conditions] == [("RSI", "below", 30.0), ("MACD", "crossover", None)]
    assert screen.parse("price crosses above the 20-day moving average").conditions[0].comparison == "crossover"
    assert screen.parse("hello").conditions == ()


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\n2024-01-01,1,2,0.5,1.2,20\n")
    b = source.load(spark, "csv", str(tmp_path / "a.csv"), "A", start="2024-01-02")
    assert b.columns == list(source.COLUMNS) and column(b, "close") == [1.5]
    with pytest.raises(ValueError):
        source.load(spark, "feed", "x")
    with pytest.raises(ValueError):
        source.normalise(spark.createDataFrame([(1,)], "close int"))
    assert source.last_bars(series(spark, A=range(1, 9), B=[1]), 3).count() == 4


def test_nulls_inside_a_series(spark):
    rows = [("A", DAY + dt.timedelta(days=i), x) for i, x in enumerate([None, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, x double")
    assert column(with_ema(df, ("e", "x", 0.5)), "e") == [None, 1.0, 1.5]
    assert with_ema(df.limit(0), ("e", "x", 0.5)).count() == 0
