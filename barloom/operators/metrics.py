"""Performance metrics, ratings and scores."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scan import Running, placed, running
from barloom.operators.backtest import COMMISSION, drawdown_runs, trades, valued

# Day counts and the risk-free rate.
DAYS_A, DAYS_B, RISK_FREE = 244, 252, 0.03


def return_metrics(returns: DataFrame, keys: tuple[str, ...] = ("symbol",), ret: str = "ret") -> DataFrame:
    """Metrics of simple returns by key, decimal units, ``DAYS_A`` bars a year; rows without a return don't count.

    Needs columns ``bar_ts`` and the return. Fewer than two returns give zeros.
    """
    r = F.col(ret)
    # A loss of everything has no logarithm: what follows it is worth nothing.
    got = running(placed(returns.where(r.isNotNull()), *keys), keys, __v=Running("sum", F.ln(1.0 + r)), __gone=Running("max", r <= -1.0))
    got = running(got, keys, __top=Running("max", "__v"))
    got = got.withColumn("__dd", F.when(F.col("__gone"), F.lit(-1.0)).otherwise(F.exp(F.col("__v") - F.col("__top")) - 1.0))
    daily = r - RISK_FREE / DAYS_A
    agg = got.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.min(r) <= -1.0, F.lit(0.0)).otherwise(F.exp(F.sum(F.ln(1.0 + r)))).alias("growth"),
        F.stddev_samp(r).alias("sd"),
        F.avg(daily).alias("excess"),
        F.stddev_samp(daily).alias("excess_sd"),
        F.stddev_samp(F.when(r < 0, r)).alias("down_sd"),
        F.min("__dd").alias("mdd"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(F.when(r > 0, r)).alias("mean_gain"),
        F.avg(F.when(r < 0, r)).alias("mean_loss"),
    )
    years = F.greatest(F.col("n") / float(DAYS_A), F.lit(0.01))
    annual = F.pow("growth", 1.0 / years) - 1.0
    root = math.sqrt(DAYS_A)
    down = F.coalesce(F.col("down_sd") * root, F.lit(0.0001))
    made = {
        "total_return": F.col("growth") - 1.0,
        "annual_return": annual,
        "volatility": F.col("sd") * root,
        "sharpe_ratio": F.coalesce(F.try_divide("excess", "excess_sd") * root, F.lit(0.0)),
        "sortino_ratio": F.try_divide(annual - RISK_FREE, down),
        "calmar_ratio": F.coalesce(F.try_divide(annual, F.abs("mdd")), F.lit(0.0)),
        "max_drawdown": F.col("mdd"),
        "win_rate": F.col("win_rate"),
        "profit_factor": F.coalesce(F.try_divide("mean_gain", F.abs("mean_loss")), F.lit(0.0)),
    }
    return agg.select(*keys, F.col("n").alias("n_returns"), *[F.when(F.col("n") >= 2, v).otherwise(F.lit(0.0)).alias(k) for k, v in made.items()])


def backtest_metrics(signalled: DataFrame, keys: tuple[str, ...] = ("symbol",), commission: float = COMMISSION) -> DataFrame:
    """Metrics of a backtest by key, decimal units, ``DAYS_B`` bars a year.

    max_drawdown is positive; profit_factor is null without a losing trade.
    """
    return valued_metrics(valued(signalled, 100_000.0, commission, *keys), keys, commission)


def valued_metrics(held: DataFrame, keys: tuple[str, ...] = ("symbol",), commission: float = COMMISSION) -> DataFrame:
    """:func:`backtest_metrics` of bars with their values."""
    daily = math.pow(1 + RISK_FREE, 1 / DAYS_B) - 1
    simple = F.exp(F.col("log_equity") - F.col("prev_equity")) - 1.0
    curve = held.withColumn("__r", simple).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("log_equity", "bar_ts").alias("v0"),
        F.max_by("log_equity", "bar_ts").alias("v1"),
        F.avg("__r").alias("mean"),
        F.stddev_samp("__r").alias("sd"),
        F.min("drawdown").alias("mdd"),
    )
    closed = trades(held, commission, *keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.avg(F.when(F.col("return_pct") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.sum(F.when(F.col("return_pct") > 0, F.col("return_pct")).otherwise(0.0)).alias("won"),
        F.sum(F.when(F.col("return_pct") < 0, F.col("return_pct")).otherwise(0.0)).alias("lost"),
    )
    both = curve.join(closed, list(keys), "left").join(drawdown_runs(held, *keys), list(keys), "left")
    years = F.greatest(F.col("n") / float(DAYS_B), F.lit(0.01))
    return both.select(
        *keys,
        (F.exp(F.col("v1") - F.ln(F.lit(100_000.0))) - 1.0).alias("total_return"),
        (F.exp((F.col("v1") - F.ln(F.lit(100_000.0))) / years) - 1.0).alias("annual_return"),
        F.coalesce(F.try_divide(F.col("mean") - daily, "sd") * math.sqrt(DAYS_B), F.lit(0.0)).alias("sharpe_ratio"),
        F.abs("mdd").alias("max_drawdown"),
        F.col("max_drawdown_bars"),
        F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"),
        F.coalesce("total_trades", F.lit(0)).cast("long").alias("total_trades"),
        F.when(F.col("lost") < 0, F.col("won") / F.abs("lost")).alias("profit_factor"),
    )


# Rating limits, scores and weights.
LIMITS = {
    "sharpe_ratio": ((2.0, "excellent"), (1.5, "good"), (0.5, "acceptable"), (0.0, "poor")),
    "annual_return": ((0.30, "excellent"), (0.15, "good"), (0.05, "acceptable"), (0.0, "poor")),
    "max_drawdown": ((0.05, "excellent"), (0.10, "good"), (0.20, "acceptable"), (0.30, "poor")),
    "win_rate": ((0.60, "excellent"), (0.50, "good"), (0.40, "acceptable"), (0.30, "poor")),
}
LOWER_IS_BETTER = ("max_drawdown",)
SCORES = {"excellent": 100.0, "good": 75.0, "acceptable": 50.0, "poor": 25.0, "critical": 0.0}
WEIGHTS = {"sharpe_ratio": 0.30, "annual_return": 0.25, "max_drawdown": 0.25, "win_rate": 0.20}
TITLES = {"sharpe_ratio": "Sharpe Ratio", "annual_return": "Annual Return", "max_drawdown": "Max Drawdown", "win_rate": "Win Rate"}
FEW_TRADES = 30


def rating(metric: str, value: Column) -> Column:
    """First limit that the value reaches; none, or no value, is critical."""
    made = F
    for limit, name in LIMITS[metric]:
        made = made.when(value <= limit if metric in LOWER_IS_BETTER else value >= limit, F.lit(name))
    return made.otherwise(F.lit("critical"))


def rated(metrics: DataFrame) -> DataFrame:
    """Adds rating_<metric>, overall_score, strengths, weaknesses and risk_warnings (arrays of metric titles), and few_trades."""
    made = metrics.withColumns({f"rating_{m}": rating(m, F.col(m)) for m in LIMITS})
    score = sum((_score(F.col(f"rating_{m}")) * w for m, w in WEIGHTS.items()), F.lit(0.0))
    listed = lambda *names: F.array_compact(F.array(*[F.when(F.col(f"rating_{m}").isin(*names), F.lit(TITLES[m])) for m in LIMITS]))
    return made.withColumns(
        {
            "overall_score": F.round(score, 2),
            "strengths": listed("excellent", "good"),
            "weaknesses": listed("poor", "critical"),
            "risk_warnings": listed("critical"),
            "few_trades": F.col("total_trades") < FEW_TRADES,
        }
    )


def _score(name: Column) -> Column:
    made = F
    for k, v in SCORES.items():
        made = made.when(name == k, F.lit(v))
    return made


def percent_score(sharpe: Column, annual: Column, dd: Column, wins: Column) -> Column:
    """Score of 0 to 100 from metrics in percent: up to 30 for Sharpe, 25 for return and drawdown each, 20 for wins; null if one is null."""
    clamp = lambda x, top: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(top), x)))
    return F.round(clamp(sharpe / 2 * 30, 30.0) + clamp(annual / 30 * 25, 25.0) + clamp((1 - F.abs(dd) / 50) * 25, 25.0) + clamp(wins / 100 * 20, 20.0), 1)


# Limits of the second rating scale, for metrics in percent, and its sentences.
SECOND = {
    "sharpe_ratio": lambda v: F.when(v > 1.5, "good").when(v > 0.5, "acceptable").when(v >= 0, "poor").otherwise("critical"),
    "annual_return": lambda v: F.when(v > 20, "good").when(v > 5, "acceptable").when(v > 0, "poor").otherwise("critical"),
    "max_drawdown": lambda v: F.when(F.abs(v) < 10, "good").when(F.abs(v) < 20, "acceptable").when(F.abs(v) < 30, "poor").otherwise("critical"),
    "win_rate": lambda v: F.when(v > 50, "good").when(v > 40, "acceptable").otherwise("poor"),
    "total_trades": lambda v: F.when(v >= FEW_TRADES, "acceptable").otherwise("poor"),
}
STRONG = {"sharpe_ratio": "Excellent risk-adjusted returns (Sharpe %.2f)", "annual_return": "Strong annual return of %.1f%%", "max_drawdown": "Controlled drawdown (%.1f%%)", "win_rate": "High win rate (%.1f%%)"}
WEAK = {
    "sharpe_ratio": "Poor risk-adjusted returns (Sharpe %.2f)", "annual_return": "Weak annual return of %.1f%%", "max_drawdown": "Excessive drawdown (%.1f%%)", "win_rate": "Low win rate (%.1f%%)",
    "total_trades": "Low trade count (%.0f) may reduce statistical significance",
}
ADVICE = (
    (lambda m: F.abs(m("max_drawdown")) >= 20, "Drawdown too high — consider adding stop-loss or trailing stop mechanisms"),
    (lambda m: F.abs(m("max_drawdown")) >= 30, "Critical drawdown level — reduce position sizing or add risk limits"),
    (lambda m: m("win_rate") < 40, "Win rate below 40% — review entry signals or add confirmation filters"),
    (lambda m: m("sharpe_ratio") < 0.5, "Low Sharpe ratio — strategy may not be compensating for risk adequately"),
    (lambda m: m("annual_return") < 5, "Low annual return — consider optimizing parameters or adding alpha sources"),
    (lambda m: m("total_trades") < FEW_TRADES, "Low trade count — extend backtest period or consider more instruments"),
)
LONG_RECOVERY, RECOVERY_ADVICE = 180, "Long drawdown recovery (%d days) — consider portfolio diversification"
SOLID = "Strategy looks solid. Consider stress-testing across different market regimes."


def in_percent(metrics: DataFrame) -> DataFrame:
    """Decimal returns, drawdown and win rate in percent."""
    return metrics.withColumns({c: F.col(c) * 100.0 for c in ("total_return", "annual_return", "max_drawdown", "win_rate")})


def diagnosed(percent: DataFrame) -> DataFrame:
    """Adds the second scale's ratings (second_<metric>), score, strengths, weaknesses and suggestions; metrics are in percent.

    Needs sharpe_ratio, annual_return, max_drawdown, win_rate, total_trades and max_drawdown_bars.
    """
    made = percent.withColumns({f"second_{m}": f(F.col(m)) for m, f in SECOND.items()})
    shown = lambda m: F.abs(m) if m == "max_drawdown" else F.col(m).cast("double")
    said = lambda table, *names: F.array_compact(F.array(*[F.when(F.col(f"second_{m}").isin(*names), F.format_string(t, F.bround(shown(m), int(re.search(r"%\.(\d)f", t)[1])))) for m, t in table.items()]))
    long = F.when(F.col("max_drawdown_bars") > LONG_RECOVERY, F.format_string(RECOVERY_ADVICE, F.col("max_drawdown_bars")))
    advice = F.array_compact(F.array(*[F.when(test(F.col), F.lit(t)) for test, t in ADVICE], long))
    return made.withColumns(
        {
            "score": percent_score(F.col("sharpe_ratio"), F.col("annual_return"), F.col("max_drawdown"), F.col("win_rate")),
            "strengths": said(STRONG, "good"),
            "weaknesses": said(WEAK, "poor", "critical"),
            "suggestions": F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(SOLID))),
        }
    )


def trade_metrics(closed: DataFrame, cash: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Metrics of closed trades by key from their profit ``pnl``: counts, win rate, average gain over average loss, and Sortino and volatility of pnl / cash.

    profit_factor is infinite with gains and no loss; Sortino without a losing
    trade divides by 0.0001, and is 0 where the losses don't vary.
    """
    r = F.col("pnl") / F.lit(float(cash))
    agg = closed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.sum((F.col("pnl") > 0).cast("long")).alias("won_trades"),
        F.sum((F.col("pnl") < 0).cast("long")).alias("lost_trades"),
        F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("gain"),
        F.abs(F.avg(F.when(F.col("pnl") < 0, F.col("pnl")))).alias("loss"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("sd"),
        F.stddev_samp(F.when(r < 0, r)).alias("down"),
    )
    down = F.when(F.col("lost_trades") == 0, F.lit(0.0001)).otherwise(F.coalesce("down", F.lit(0.0)))
    return agg.select(
        *keys,
        "total_trades",
        "won_trades",
        "lost_trades",
        (F.col("won_trades") / F.col("total_trades")).alias("win_rate"),
        F.when(F.coalesce("loss", F.lit(0.0)) > 0, F.coalesce("gain", F.lit(0.0)) / F.col("loss")).when(F.col("gain") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("profit_factor"),
        F.when(down > 0, F.col("mean") / down).otherwise(F.lit(0.0)).alias("sortino_ratio"),
        F.coalesce("sd", F.lit(0.0)).alias("volatility"),
    )


def strategy_results(signalled: DataFrame, keys: tuple[str, ...] = ("symbol",), commission: float = COMMISSION, least: int = 50) -> DataFrame:
    """A backtest's results in percent by key, as reports show them: two places, four for the Sharpe ratio.

    Symbols of fewer than ``least`` bars have zeros throughout, since indicators mean nothing there.
    """
    bars = signalled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars"))
    made = bars.join(backtest_metrics(signalled, keys, commission), list(keys))
    enough = F.col("n_bars") >= least
    percent = {c: F.round(F.col(c) * 100.0, 2) + F.lit(0.0) for c in ("total_return", "annual_return", "max_drawdown", "win_rate")}
    shown = percent | {"sharpe_ratio": F.round("sharpe_ratio", 4) + F.lit(0.0)}
    whole = {c: F.when(enough, F.col(c)).otherwise(F.lit(0).cast("long")) for c in ("total_trades", "max_drawdown_bars")}
    return made.select(*keys, "n_bars", *[F.when(enough, v).otherwise(F.lit(0.0)).alias(c) for c, v in shown.items()], *[v.alias(c) for c, v in whole.items()])


#: Commission of the trade-based engine.
LOW_COMMISSION = 0.0003
LEAST_BARS = 50


def engine_metrics(signalled: DataFrame, cash: float = 100_000.0, commission: float = LOW_COMMISSION) -> DataFrame:
    """A backtest at a low commission with metrics of its trades by symbol, beside those of its curve.

    A trade's profit follows from the cash before and after it. Symbols of fewer
    than ``LEAST_BARS`` bars, or without a trade, have zeros.
    """
    held = valued(signalled, cash, commission, "symbol")
    opened = Running("last", F.when(F.col("entry"), F.coalesce(F.exp("prev_equity"), F.lit(float(cash)))))
    closed = running(held, ("symbol",), __open=opened).where("exit").withColumn("pnl", F.exp("log_equity") - F.col("__open"))
    per_trade = trade_metrics(closed, cash)
    curve = valued_metrics(held, ("symbol",), commission).select("symbol", "total_return", "annual_return", "sharpe_ratio", "max_drawdown", "max_drawdown_bars")
    bars = signalled.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    joined = bars.join(curve, "symbol").join(per_trade, "symbol", "left")
    calmar = F.when((F.col("max_drawdown") > 0) & (F.coalesce("total_trades", F.lit(0)) > 0), F.col("annual_return") / F.col("max_drawdown")).otherwise(F.lit(0.0))
    names = [c for c in (*curve.columns[1:], *per_trade.columns[1:])]
    made = joined.withColumn("calmar_ratio", calmar)
    zero = lambda c: F.when(F.col("n_bars") >= LEAST_BARS, F.coalesce(c, F.lit(0).cast(made.schema[c].dataType))).otherwise(F.lit(0).cast(made.schema[c].dataType)).alias(c)
    return made.select("symbol", "n_bars", *[zero(c) for c in (*names, "calmar_ratio")])


def compare_best(metrics: DataFrame, name: str = "symbol", score: str = "overall_score") -> DataFrame:
    """The best name and score; of equal scores the first name."""
    return metrics.orderBy(F.desc(score), name).limit(1).select(F.col(name).alias("best"), F.col(score).alias("best_score"))


def side_by_side(metrics: DataFrame, names: list[str], name: str = "symbol") -> DataFrame:
    """Metrics as rows, compared names as columns."""
    long = metrics.select(name, *[F.col(m).cast("double") for m in LIMITS]).unpivot(name, list(LIMITS), "metric", "value")
    return long.groupBy("metric").pivot(name, names).agg(F.first("value"))


def overfit_score(inside: dict[str, Column], outside: dict[str, Column], n_params: Column) -> Column:
    """0 to 1 from metrics inside and outside the sample; names as in ``backtest_metrics``."""
    fall = inside["total_return"] - outside["total_return"]
    turned = (inside["total_return"] > 0) & (outside["total_return"] < 0)
    dd_in, dd_out = F.abs(inside["max_drawdown"]), F.abs(outside["max_drawdown"])
    parts = [
        F.when(inside["sharpe_ratio"] > 5, 0.4).when(inside["sharpe_ratio"] > 3, 0.2),
        F.when(turned & (fall > 0.3), 0.4).when(turned, 0.25).when((inside["sharpe_ratio"] > 1) & (outside["sharpe_ratio"] < 0), 0.3),
        F.when((dd_in > 0) & (dd_out > dd_in * 2.5), 0.2).when((dd_in > 0) & (dd_out > dd_in * 1.8), 0.1),
        F.when((inside["win_rate"] > 0.6) & (outside["win_rate"] < 0.4), 0.15),
        F.when(n_params > 10, 0.2).when(n_params > 6, 0.1),
        F.when((inside["profit_factor"] > 2) & (outside["profit_factor"] < 1), 0.15),
    ]
    return F.least(F.lit(1.0), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))


# What an overfit check warns of, and what is recommended then.
WARNINGS = ("sharpe", "sharpe_cliff", "drawdown", "win_rate", "parameters", "profit_factor")
RECOMMENDED = {
    "high_sharpe": ("降低对Sharpe比率的期望，真实市场中2.0以上已属优秀",),
    "sharpe_cliff": ("使用前向验证 (Walk-Forward) 重新评估策略稳健性", "减少策略参数数量，使用更简单的逻辑"),
    "drawdown": ("增加风险管理规则，如动态止损", "在更多历史数据上测试策略，覆盖不同市场环境"),
    "parameters": ("精简策略逻辑，保留核心交易信号", "使用参数优化器的随机搜索代替网格搜索"),
    "sharpe": ("检查是否使用了未来数据（look-ahead bias）", "考虑交易成本和滑点的影响"),
    "win_rate": ("避免过度优化入场条件", "增加样本外验证数据量"),
}
STEADY = "策略表现稳健，建议继续监控实盘表现"


def overfit_warnings(inside: dict[str, Column], outside: dict[str, Column], n_params: Column) -> Column:
    """Names of the checks of ``overfit_score`` that hold, in the order of ``WARNINGS``."""
    dd_in, dd_out = F.abs(inside["max_drawdown"]), F.abs(outside["max_drawdown"])
    turned = (inside["total_return"] > 0) & (outside["total_return"] < 0)
    held = (
        inside["sharpe_ratio"] > 3,
        turned | ((inside["sharpe_ratio"] > 1) & (outside["sharpe_ratio"] < 0)),
        (dd_in > 0) & (dd_out > dd_in * 1.8),
        (inside["win_rate"] > 0.6) & (outside["win_rate"] < 0.4),
        n_params > 6,
        (inside["profit_factor"] > 2) & (outside["profit_factor"] < 1),
    )
    return F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h in zip(WARNINGS, held, strict=True)]))


def overfit_advice(warnings: Column, inside_sharpe: Column) -> Column:
    """Recommendations for the warnings, in the order of ``RECOMMENDED``; one for a steady strategy without any."""
    parts = [F.when(inside_sharpe > 3 if name == "high_sharpe" else F.array_contains(warnings, name), F.array(*map(F.lit, said))).otherwise(F.array().cast("array<string>")) for name, said in RECOMMENDED.items()]
    made = F.concat(*parts)
    return F.when(F.size(made) > 0, made).otherwise(F.array(F.lit(STEADY)))
