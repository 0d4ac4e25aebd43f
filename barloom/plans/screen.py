"""Screens: conditions over indicators, compiled to columns and judged on each symbol's last bar."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import before, crossed_down, crossed_up
from barloom.operators import indicators as ind
from barloom.sources import bars as bars_source

COMPARISONS = ("above", "below", "crossover", "crossunder")
LEAST_BARS = 5


@dataclass(frozen=True)
class Condition:
    name: str
    comparison: str
    value: float | None = None
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.comparison not in COMPARISONS:
            raise ValueError(f"unknown comparison: {self.comparison}")


@dataclass(frozen=True)
class Screen:
    conditions: tuple[Condition, ...] = ()
    days: int = 60


def _n(p: dict, name: str, default: float) -> int:
    return int(p.get(name, default))


def _add(df: DataFrame, c: Condition) -> tuple[DataFrame, str, list[str]]:
    """The table with the condition's indicator, its key and its columns; each indicator is made once."""
    kind, p = c.name.upper(), c.params
    rename = lambda made, names, key: made.withColumnsRenamed({n: f"{key}__{n}" for n in names})
    if kind == "RSI":
        key, names = f"rsi_{_n(p, 'period', 14)}", ["rsi"]
        build = lambda: ind.rsi_wilder(df, _n(p, "period", 14))
    elif kind == "MACD":
        a = _n(p, "fast", 12), _n(p, "slow", 26), _n(p, "signal", 9)
        key, names = "macd_{}_{}_{}".format(*a), ["macd", "macd_signal", "macd_hist"]
        build = lambda: ind.macd(df, *a)
    elif kind in ("SMA", "MA"):
        key, names = f"sma_{_n(p, 'period', 20)}", ["sma"]
        build = lambda: ind.sma(df, _n(p, "period", 20))
    elif kind == "EMA":
        key, names = f"ema_{_n(p, 'period', 20)}", ["ema"]
        build = lambda: ind.ema(df, _n(p, "period", 20))
    elif kind in ("BOLL", "BOLLINGER"):
        key, names = f"boll_{_n(p, 'period', 20)}_{p.get('std', 2):g}", ["boll_mid", "boll_upper", "boll_lower"]
        build = lambda: ind.bollinger(df, _n(p, "period", 20), float(p.get("std", 2)))
    elif kind in ("KDJ", "KD"):
        a = _n(p, "n", 9), _n(p, "m1", 3), _n(p, "m2", 3)
        key, names = "kdj_{}_{}_{}".format(*a), ["k", "d", "j"]
        build = lambda: ind.kdj(df, *a)
    else:
        return df, "", []
    key = key.replace(".", "p")
    if f"{key}__{names[0]}" in df.columns:
        return df, key, names
    return rename(build(), names, key), key, names


def _test(c: Condition, key: str) -> Column:
    at = lambda n: F.col(f"{key}__{n}")
    prev = lambda n: before(at(n))
    kind, v, close = c.name.upper(), c.value, F.col("close")
    no = F.lit(False)

    def sides(a: Column, up: Column, down: Column, prev_a: Column, prev_up: Column, prev_down: Column, over: Column | None = None, under: Column | None = None) -> Column:
        return {
            "above": (a > up) if over is None else over,
            "below": (a < down) if under is None else under,
            "crossover": crossed_up(a, up, prev_a, prev_up),
            "crossunder": crossed_down(a, down, prev_a, prev_down),
        }[c.comparison]

    against = lambda a: (no, no) if v is None else (a > v, a < v)
    if kind == "RSI":
        level = F.lit(50.0 if v is None else float(v))
        over, under = against(at("rsi"))
        return sides(at("rsi"), level, level, prev("rsi"), level, level, over, under)
    if kind == "MACD":
        return sides(at("macd"), at("macd_signal"), at("macd_signal"), prev("macd"), prev("macd_signal"), prev("macd_signal"))
    if kind in ("SMA", "MA", "EMA"):
        n = "ema" if kind == "EMA" else "sma"
        return sides(close, at(n), at(n), before(close), prev(n), prev(n))
    if kind in ("BOLL", "BOLLINGER"):
        return sides(close, at("boll_upper"), at("boll_lower"), before(close), prev("boll_upper"), prev("boll_lower"))
    if kind in ("KDJ", "KD"):
        over, under = against(at("k"))
        return sides(at("k"), at("d"), at("d"), prev("k"), prev("d"), prev("d"), over, under)
    if kind == "PRICE" and v is not None:
        return {"above": close > v, "below": close < v}.get(c.comparison, no)
    return no


def run(screen: Screen, bars: DataFrame) -> DataFrame:
    """One row for each symbol: symbol, matched, indicators (map of latest values, 4 places), explanation.

    All conditions must hold on the last bar; without any, every symbol matches;
    a symbol with fewer than five bars doesn't.
    """
    df, keys = bars_source.last_bars(bars, screen.days), []
    for c in screen.conditions:
        df, key, names = _add(df, c)
        keys.append((c, key, names))
    tested = df.withColumns({f"__t{i}": F.coalesce(_test(c, key), F.lit(False)) for i, (c, key, _) in enumerate(keys)})
    held = [f"__t{i}" for i in range(len(keys))]
    shown = list(dict.fromkeys(f"{key}__{n}" for _, key, names in keys for n in names))
    last = tested.groupBy("symbol").agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.struct(*[F.col(f"`{c}`") for c in ("close", *shown, *held)]), "bar_ts").alias("r"))
    enough = F.col("__n") >= LEAST_BARS
    matched = F.lit(True)
    for h in held:
        matched = matched & F.col(f"r.{h}")
    said = [F.concat(F.lit(f"{c.name.upper()} {c.comparison}{'' if c.value is None else f' {c.value:g}'}: "), F.when(F.col(f"r.{h}"), "yes").otherwise("no")) for (c, _, _), h in zip(keys, held, strict=True)]
    values = F.map_from_arrays(F.array(*[F.lit(s.replace("__", ".")) for s in ("close", *shown)]), F.array(*[F.round(F.col("r").getField(s), 4) for s in ("close", *shown)]))
    explained = F.concat_ws("; ", *said) if said else F.lit("No conditions.")
    if not keys:
        return last.select("symbol", F.lit(True).alias("matched"), values.alias("indicators"), explained.alias("explanation"))
    return last.select("symbol", (enough & matched).alias("matched"), values.alias("indicators"), F.when(enough, explained).otherwise("Insufficient data.").alias("explanation"))


#: Phrases, most specific first; the number of a condition follows its name.
_NAMES = {"RSI": "rsi", "MACD": "macd", "KDJ": "kdj|kd", "BOLL": "boll(?:inger)?|布林", "EMA": "ema", "MA": "sma|ma|均线|moving average", "PRICE": "price|价格|股价|close"}
_WORDS = {
    "crossover": r"golden cross|crosses? above|cross(?:ing)? up|crossover|金叉|上穿|breaks? above|突破",
    "crossunder": r"death cross|crosses? below|cross(?:ing)? down|crossunder|死叉|下穿|breaks? below|跌破",
    "above": r"above|over|greater than|higher than|overbought|>|大于|高于|超过|超买",
    "below": r"below|under|less than|lower than|oversold|<|小于|低于|超卖",
}
_PERIOD = {"RSI": "period", "MA": "period", "EMA": "period", "BOLL": "period"}


def parse(text: str) -> Screen:
    """Conditions named in a short request, by fixed phrases; clauses end at and, commas and full stops."""
    found = []
    for clause in re.split(r"\band\b|,|;|，|。|且|并且|同时|\.(?!\d)", text.lower()):
        kind = next((k for k, p in _NAMES.items() if re.search(rf"(?<![a-z])(?:{p})(?![a-z])", clause)), None)
        comparison = next((c for c, p in _WORDS.items() if re.search(p, clause)), None)
        if kind is None or comparison is None:
            continue
        params, rest = {}, re.sub(r"\b\d+\s*(?:days?|日|天)\b", " ", clause)
        if kind in _PERIOD and (m := re.search(rf"(?:{_NAMES[kind]})\s*\(?\s*(\d+)\)?|(\d+)[- ]?(?:day|period|日)", clause)):
            n = next(x for x in m.groups() if x)
            if kind != "RSI" or "(" in m[0] or m[2]:
                params, rest = {_PERIOD[kind]: int(n)}, rest.replace(m[0], " ", 1)
        numbers = re.findall(r"\d+(?:\.\d+)?", rest)
        value = float(numbers[-1]) if numbers and kind in ("RSI", "KDJ", "PRICE") else None
        if value is None and kind in ("RSI", "KDJ"):
            value = 70.0 if "overbought" in clause or "超买" in clause else 30.0 if "oversold" in clause or "超卖" in clause else None
        found.append(Condition(kind, comparison, value, params))
    days = re.search(r"(?:last|past|最近|近)\s*(\d+)\s*(?:days?|日|天)", text.lower())
    return Screen(tuple(found), min(365, max(1, int(days[1]))) if days else 60)
