"""Parameter search, walk-forward validation and overfit checks as one plan over all symbols."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.scan import AT, placed
from barloom.functions.windows import before, crossed_down, crossed_up, full, history, ordered, roll
from barloom.operators import metrics
from barloom.operators.backtest import COMMISSION


def grid(**values: list) -> list[dict]:
    """All combinations, the last name fastest; no names give one empty combination."""
    return [dict(zip(values, row, strict=True)) for row in itertools.product(*values.values())]


def sma_cross_signals(bars: DataFrame, combinations: list[dict]) -> DataFrame:
    """Bars for each combination of ``fast`` and ``slow``, with param_id and signal.

    Each distinct period is averaged once; combinations only multiply the rows after that.
    """
    periods = sorted({p[k] for p in combinations for k in ("fast", "slow")})
    made = placed(bars, "symbol").withColumns({f"__m{n}": full(n, F.avg("close").over(roll(n))) for n in periods})
    made = made.withColumns({f"__p{n}": before(f"__m{n}") for n in periods})
    each = []
    for i, p in enumerate(combinations):
        sides = [F.col(f"__{c}{p[k]}") for c in "mp" for k in ("fast", "slow")]
        signal = F.when(crossed_down(*sides), -1).when(crossed_up(*sides), 1).otherwise(0)
        each.append(F.struct(F.lit(i).alias("param_id"), F.lit(p["fast"]).alias("fast"), F.lit(p["slow"]).alias("slow"), signal.alias("signal")))
    return made.withColumn("__e", F.explode(F.array(*each))).select("symbol", "bar_ts", "close", AT, "__e.*")


def grid_search(bars: DataFrame, combinations: list[dict], metric: str = "total_return", commission: float = COMMISSION) -> DataFrame:
    """(symbol, param_id, score) of every combination; a missing score counts as 0."""
    tried = metrics.backtest_metrics(sma_cross_signals(bars, combinations), ("symbol", "param_id"), commission)
    return tried.select("symbol", "param_id", F.coalesce(metric, F.lit(0.0)).alias("score"))


def best_of(scores: DataFrame) -> DataFrame:
    """The best combination of each symbol; of equal ones the first."""
    best = F.max_by("param_id", F.struct("score", -F.col("param_id")))
    return scores.groupBy("symbol").agg(best.alias("param_id"), F.max("score").alias("score"))


def random_combinations(space: dict, trials: int, seed: int = 0) -> list[dict]:
    """Two numbers are a range, longer lists a choice; seeded."""
    import random

    rng = random.Random(seed)
    draw = lambda v: (rng.randint(*v) if all(isinstance(x, int) for x in v) else rng.uniform(*v)) if len(v) == 2 else rng.choice(v)
    return [{k: draw(v) for k, v in space.items()} for _ in range(trials)]


def folds(bars: DataFrame, splits: int = 5, train_ratio: float = 0.7) -> DataFrame:
    """Bars repeated for each fold they belong to, with fold and part (train or test).

    Folds start every n div splits bars and overlap; those of fewer than 30
    training or 10 test bars are left out.
    """
    n = history()
    numbered = bars.withColumn("__i", F.row_number().over(ordered()) - 1).withColumn("__n", n)
    size = F.floor(F.col("__n") / splits)
    total = (size / F.lit(1.0 - train_ratio)).cast("int")
    each = numbered.withColumn("__size", size).withColumn("__total", total).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    start = F.col("fold") * F.col("__size")
    cut = F.least(start + (F.col("__total") * F.lit(train_ratio)).cast("int"), F.col("__n"))
    end = F.least(start + F.col("__total"), F.col("__n"))
    inside = each.withColumns({"__start": start, "__cut": cut, "__end": end}).where("__i >= __start and __i < __end and __cut - __start >= 30 and __end - __cut >= 10")
    return inside.withColumn("part", F.when(F.col("__i") < F.col("__cut"), "train").otherwise("test")).drop("__i", "__n", "__size", "__total", "__start", "__cut", "__end")


def walk_forward(bars: DataFrame, fast: int = 10, slow: int = 30, splits: int = 5, train_ratio: float = 0.7) -> DataFrame:
    """(symbol, fold, train_return, test_return) of a moving-average cross run afresh on each part."""
    keys = ("symbol", "fold", "part")
    parts = folds(placed(bars, "symbol"), splits, train_ratio)
    mean = lambda n: full(n, F.avg("close").over(roll(n, *keys)), "close", *keys)
    made = parts.withColumn("__f", mean(fast)).withColumn("__s", mean(slow))
    sides = F.col("__f"), F.col("__s"), before("__f", 1, *keys), before("__s", 1, *keys)
    signalled = made.withColumn("signal", F.when(crossed_down(*sides), -1).when(crossed_up(*sides), 1).otherwise(0))
    got = metrics.backtest_metrics(signalled, keys)
    pick = lambda part: F.max(F.when(F.col("part") == part, F.col("total_return")))
    return got.groupBy("symbol", "fold").agg(pick("train").alias("train_return"), pick("test").alias("test_return"))


def walk_forward_summary(by_fold: DataFrame) -> DataFrame:
    """Mean returns, their ratio (0 or 1 where the first is 0) and whether the strategy holds up."""
    agg = by_fold.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_folds"), F.avg("train_return").alias("mean_train"), F.avg("test_return").alias("mean_test"))
    ratio = F.when(F.col("mean_train") != 0, F.try_divide("mean_test", "mean_train")).otherwise(F.when(F.col("mean_test") == 0, 0.0).otherwise(1.0))
    return agg.withColumn("degradation_ratio", ratio).withColumn("robust", (ratio > 0.5) & (F.col("mean_test") > 0))


def overfit(bars: DataFrame, fast: int = 10, slow: int = 30, share: float = 0.7, report: bool = False) -> DataFrame:
    """(symbol, overfit_score) of a moving-average cross between the first ``share`` of the bars and the rest; with ``report`` also warnings and recommendations."""
    keys = ("symbol", "part")
    rank = F.percent_rank().over(W.partitionBy("symbol").orderBy("bar_ts"))
    parts = placed(bars, "symbol").withColumn("part", F.when(rank <= share, "train").otherwise("test"))
    mean = lambda n: full(n, F.avg("close").over(roll(n, *keys)), "close", *keys)
    made = parts.withColumn("__f", mean(fast)).withColumn("__s", mean(slow))
    sides = F.col("__f"), F.col("__s"), before("__f", 1, *keys), before("__s", 1, *keys)
    got = metrics.backtest_metrics(made.withColumn("signal", F.when(crossed_down(*sides), -1).when(crossed_up(*sides), 1).otherwise(0)), keys)
    names = ("total_return", "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor")
    pick = lambda part: [F.max(F.when(F.col("part") == part, F.coalesce(n, F.lit(0.0)))).alias(f"{part}_{n}") for n in names]
    both = got.groupBy("symbol").agg(*pick("train"), *pick("test"))
    side = lambda part: {n: F.col(f"{part}_{n}") for n in names}
    sides = side("train"), side("test"), F.lit(2)
    made = both.withColumn("overfit_score", metrics.overfit_score(*sides))
    if not report:
        return made.select("symbol", "overfit_score")
    warned = made.withColumn("warnings", metrics.overfit_warnings(*sides))
    return warned.select("symbol", "overfit_score", "warnings", metrics.overfit_advice(F.col("warnings"), F.col("train_sharpe_ratio")).alias("recommendations"))
