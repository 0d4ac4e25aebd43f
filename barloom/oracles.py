"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

from barloom.operators.optimise import random_combinations

HOURLY = """bars as (select event_type symbol, date_trunc('hour', ts)::timestamp bar_ts, arg_min(value, {'t': ts, 'e': event_id}) "open", max(value) high, min(value) low,
  arg_max(value, {'t': ts, 'e': event_id}) "close", count(*) volume from events group by 1, 2)"""
ORDERS = """bars as (select o_orderpriority symbol, date_trunc('day', o_orderdate)::timestamp bar_ts,
  arg_min(o_totalprice, {'d': o_orderdate, 'k': o_orderkey}) "open", max(o_totalprice) high, min(o_totalprice) low,
  arg_max(o_totalprice, {'d': o_orderdate, 'k': o_orderkey}) "close", count(*) volume from orders group by 1, 2)"""
ORDER = "(partition by symbol order by bar_ts)"


def r(n: int) -> str:
    return f"(partition by symbol order by bar_ts rows between {n - 1} preceding and current row)"


def full(n: int, made: str, of: str = "close") -> str:
    return f'case when count("{of}") over {r(n)} = {n} then {made} end'


#: Bars of means over 24 hours.
TREND = HOURLY.replace("bars as", "raw as", 1) + ", bars as (select symbol, bar_ts, " + ", ".join(f'avg("{c}") over {r(24)} "{c}"' for c in ("open", "high", "low", "close")) + ", volume from raw)"


def lag(x: str, keys: str = "symbol") -> str:
    return f"lag({x}) over (partition by {keys} order by bar_ts)"


def up(a: str, b: str) -> str:
    return f"coalesce({a} > {b} and prev_{a} <= prev_{b}, false)"


def down(a: str, b: str) -> str:
    return f"coalesce({a} < {b} and prev_{a} >= prev_{b}, false)"


def shown(columns: dict[str, str], *ctes: str, source: str = "bars", base: str = HOURLY) -> str:
    """Select symbol, bar_ts and the columns, floats rounded to six places."""
    return f"with recursive {', '.join([base, *ctes])} select symbol, bar_ts, {', '.join(f'{v} {k}' for k, v in columns.items())} from {source}"


def six(x: str) -> str:
    return f"round(({x})::double, 6) + 0.0::double"


def ema(name: str, source: str, value: str, alpha: float, out: str) -> list[str]:
    """CTEs of an exponential mean of ``value`` in ``source`` (which needs i, the row number): ``name`` has symbol, i, out."""
    return [
        f"{name}_in as (select symbol, i, {value} x, row_number() over (partition by symbol order by i) j from {source} where {value} is not null)",
        f"{name} as (select symbol, i, j, x::double {out} from {name}_in where j = 1 union all "
        f"select n.symbol, n.i, n.j, {1 - alpha!r} * e.{out} + {alpha!r} * n.x from {name} e join {name}_in n on n.symbol = e.symbol and n.j = e.j + 1)",
    ]


NUMBERED = f"numbered as (select *, row_number() over {ORDER} i, count(*) over (partition by symbol) n, {lag('close')} prev from bars)"
MOVES = (
    "moves as (select *, case when prev is not null then greatest(\"close\" - prev, 0) end g, case when prev is not null then greatest(prev - \"close\", 0) end l, greatest(high - low, abs(high - prev), abs(low - prev)) tr from numbered)"
)


def rsi(g: str, l: str) -> str:
    return f"case when {l} = 0 then case when {g} > 0 then 100.0::double end else 100.0 - 100.0 / (1.0 + {g} / nullif({l}, 0)) end"


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


C = '"close"'
HL = (f"max(high) over {r(14)}", f"min(low) over {r(14)}")
SMA20, SD20 = f"avg({C}) over {r(20)}", f"stddev_samp({C}) over {r(20)}"
MACD_CTES = [
    NUMBERED,
    *ema("ef", "numbered", C, span(12), "f"),
    *ema("es", "numbered", C, span(26), "s"),
    "fs as (select ef.symbol, ef.i, f - s macd from ef join es using (symbol, i))",
    *ema("sg", "fs", "macd", span(9), "macd_signal"),
    "lines as (select n.*, b.macd, sg.macd_signal from numbered n join fs b using (symbol, i) join sg using (symbol, i))",
]
RSI14 = [
    NUMBERED,
    MOVES,
    f"means as (select *, {full(14, f'avg(g) over {r(14)}', 'g')} ag, {full(14, f'avg(l) over {r(14)}', 'l')} al from moves)",
    f"rsis as (select *, {rsi('ag', 'al')} rsi from means)",
]
BREAK = [
    f"don as (select *, {full(20, f'max(high) over {r(20)}', 'high')} u, {full(10, f'min(low) over {r(10)}', 'low')} d from bars)",
    f"brk as (select *, coalesce({C} > {lag('u')}, false) bu, coalesce({C} < {lag('d')}, false) bd from don)",
]
DAYS_A = 244


def signal(buy: str, sell: str) -> str:
    return f"case when {sell} then -1 when {buy} then 1 else 0 end"


CANDLES = f"""c as (select *, {lag('"open"')} o1, {lag(C)} c1, {lag('high')} h1, {lag('low')} l1, lag("open", 2) over {ORDER} o2, lag({C}, 2) over {ORDER} c2,
  abs({C} - "open") body, high - low rng, high - greatest("open", {C}) us, least("open", {C}) - low ls from bars)"""
PATTERNS = {
    "bullish_engulfing": f'c1 < o1 and {C} > "open" and "open" <= c1 and {C} >= o1',
    "bearish_engulfing": f'c1 > o1 and {C} < "open" and "open" >= c1 and {C} <= o1',
    "doji": "rng > 0 and body / nullif(rng, 0) < 0.1::double",
    "hammer": "rng > 0 and body > 0 and ((ls >= 2 * body and us <= 0.3::double * rng) or (us >= 2 * body and ls <= 0.3::double * rng))",
    "morning_star": f'c2 < o2 and h1 - l1 > 0 and abs(c1 - o1) / nullif(h1 - l1, 0) <= 0.3::double and greatest(o1, c1) < least(o2, c2) and {C} > "open" and {C} >= (o2 + c2) / 2',
    "evening_star": f'c2 > o2 and h1 - l1 > 0 and abs(c1 - o1) / nullif(h1 - l1, 0) <= 0.3::double and least(o1, c1) > greatest(o2, c2) and {C} < "open" and {C} <= (o2 + c2) / 2',
    "three_white_soldiers": f'c2 > o2 and c1 > o1 and {C} > "open" and o1 > o2 and o1 < c2 and c1 > c2 and "open" > o1 and "open" < c1 and {C} > c1',
    "three_black_crows": f'c2 < o2 and c1 < o1 and {C} < "open" and o1 < o2 and o1 > c2 and c1 < c2 and "open" < o1 and "open" > c1 and {C} < c1',
}
PATTERNS = {k: f"coalesce({v}, false)" for k, v in PATTERNS.items()}

#: Signals of an RSI strategy on smoothed hourly bars, for trades, equity and metrics.
SIGNALLED = [*RSI14, "sig as (select *, " + signal("rsi < 45", "rsi > 60") + " signal from rsis)"]


def positions(source: str = "sig", keys: str = "symbol", name: str = "pos") -> list[str]:
    w = f"(partition by {keys} order by bar_ts rows between unbounded preceding and current row)"
    return [
        f"{name}0 as (select *, coalesce(last_value(nullif(signal, 0) ignore nulls) over {w}, -1) = 1 holding from {source})",
        f"{name}1 as (select *, coalesce({lag('holding', keys)}, false) was, row_number() over (partition by {keys} order by bar_ts) rn from {name}0)",
        f"{name}2 as (select *, holding and not was entry, was and not holding ext from {name}1)",
        f"{name} as (select *, last_value(case when entry then {C} end ignore nulls) over {w} ep, last_value(case when entry then bar_ts end ignore nulls) over {w} et, "
        f"last_value(case when entry then rn end ignore nulls) over {w} er from {name}2)",
    ]


def equity(keys: str = "symbol", source: str = "pos", name: str = "eq", commission: float = 0.001) -> list[str]:
    w = f"(partition by {keys} order by bar_ts rows between unbounded preceding and current row)"
    side = f"ln(1.0::double - {commission}::double)"
    return [
        f"{name}0 as (select *, ln(100000.0::double) + sum(case when ext then 2 * {side} + ln({C}) - ln(ep) else 0.0::double end) over {w} cash from {source})",
        f"{name}1 as (select *, case when holding then cash + {side} + ln({C}) - ln(ep) else cash end le from {name}0)",
        f"{name} as (select *, exp(le - max(le) over {w}) - 1.0 dd, exp(le - {lag('le', keys)}) - 1.0 rr from {name}1)",
    ]


def backtest(keys: str = "symbol", source: str = "sig", prefix: str = "", commission: float = 0.001) -> list[str]:
    """CTE ``{prefix}bt`` with the metrics of a backtest by ``keys``."""
    p = prefix
    w = f"(partition by {keys} order by bar_ts rows between unbounded preceding and current row)"
    join = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    pct = f"(({C} - ep) / ep - 2 * 0.001::double) * 100.0"
    years = "greatest(n / 252.0::double, 0.01::double)"
    return [
        *positions(source, keys, f"{p}pos"),
        *equity(keys, f"{p}pos", f"{p}eq", commission),
        f"{p}curve as (select {keys}, count(*) n, arg_min(le, bar_ts) v0, arg_max(le, bar_ts) v1, avg(rr) m, stddev_samp(rr) sd, min(dd) mdd from {p}eq group by {keys})",
        f"{p}tr as (select {keys}, count(*) nt, avg(case when {pct} > 0 then 1.0::double else 0.0::double end) wr, sum(case when {pct} > 0 then {pct} else 0 end) won, "
        f"sum(case when {pct} < 0 then {pct} else 0 end) lost from {p}pos where ext group by {keys})",
        f"{p}isl as (select *, sum(case when dd < 0 then 0 else 1 end) over {w} isl from {p}eq)",
        f"{p}runs as (select {keys}, max(k)::bigint runs from (select {keys}, isl, sum(case when dd < 0 then 1 else 0 end) k from {p}isl group by {keys}, isl) group by {keys})",
        f"{p}bt as (select a.*, exp(v1 - ln(100000.0::double)) - 1.0 total_return, exp((v1 - ln(100000.0::double)) / {years}) - 1.0 annual_return, "
        f"coalesce((m - (pow(1.03::double, 1 / 252.0::double) - 1)) / nullif(sd, 0) * sqrt(252.0::double), 0.0) sharpe_ratio, abs(mdd) max_drawdown, r.runs max_drawdown_bars, "
        f"coalesce(wr, 0.0::double) win_rate, coalesce(nt, 0)::bigint total_trades, case when lost < 0 then won / abs(lost) end profit_factor "
        f"from {p}curve a left join {p}tr b on {join} left join {p}runs r on {join.replace('b.', 'r.')})",
    ]


BT_COLUMNS = ("total_return", "annual_return", "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor")


def rating(metric: str, limits: tuple, lower: bool) -> str:
    return "case " + " ".join(f"when {metric} {'<=' if lower else '>='} {x}::double then '{n}'" for x, n in limits) + " else 'critical' end"


def ratings_cte() -> str:
    from barloom.operators.metrics import LIMITS, LOWER_IS_BETTER, SCORES, WEIGHTS

    named = ", ".join(f"{rating(m, x, m in LOWER_IS_BETTER)} rating_{m}" for m, x in LIMITS.items())
    score = " + ".join(f"(case rating_{m} " + " ".join(f"when '{n}' then {s}::double" for n, s in SCORES.items()) + f" end) * {w}::double" for m, w in WEIGHTS.items())
    return f"named as (select *, {named} from bt), rated as (select *, round({score}, 2) overall_score from named)"


def sized(cash: float = 1000.0, stake: float = 0.95, commission: float = 0.001) -> list[str]:
    """Whole shares over the signals in order: ``st`` has the state after each signal and, where a position was closed, the trade."""
    size = f'floor(s.cash * {stake}::double / e."close")::bigint'
    opens = f"s.sh = 0 and e.signal = 1 and {size} > 0"
    closes = "s.sh > 0 and e.signal = -1"
    got = f's.cash + s.sh * e."close" * (1.0::double - {commission}::double)'
    pnl = f'(e."close" - s.ep) * s.sh - {commission}::double * (s.sh * s.ep) - {commission}::double * (s.sh * e."close")'
    return [
        'ev as (select symbol, bar_ts, "close"::double "close", signal, row_number() over (partition by symbol order by bar_ts) n from sig where signal <> 0 and "close" > 0)',
        f"st as (select distinct symbol, 0::bigint n, {cash}::double cash, 0::bigint sh, null::double ep, null::timestamp et, null::timestamp xt, null::bigint tsh, null::double tep, null::double xp, null::timestamp tet, null::double pnl from sig union all "
        f'select e.symbol, e.n, case when {opens} then s.cash - {size} * e."close" * (1.0::double + {commission}::double) when {closes} then {got} else s.cash end, '
        f'case when {opens} then {size} when {closes} then 0 else s.sh end, case when {opens} then e."close" when {closes} then null else s.ep end, case when {opens} then e.bar_ts when {closes} then null else s.et end, '
        f'case when {closes} then e.bar_ts end, case when {closes} then s.sh end, case when {closes} then s.ep end, case when {closes} then e."close" end, case when {closes} then s.et end, case when {closes} then {pnl} end '
        "from st s join ev e on e.symbol = s.symbol and e.n = s.n + 1)",
    ]


def cross_signals(fast: int, slow: int, keys: str, source: str, name: str) -> list[str]:
    w = lambda n: f"(partition by {keys} order by bar_ts rows between {n - 1} preceding and current row)"
    m = lambda n: f"case when count({C}) over {w(n)} = {n} then avg({C}) over {w(n)} end"
    return [
        f"{name}m as (select *, {m(fast)} f, {m(slow)} s from {source})",
        f"{name}p as (select *, {lag('f', keys)} prev_f, {lag('s', keys)} prev_s from {name}m)",
        f"{name} as (select *, {signal(up('f', 's'), down('f', 's'))} signal from {name}p)",
    ]


def search_signals() -> list[str]:
    """CTE ``tried``: two crossings of exponential means, two limits of RSI and two widths of bands; needs ``rsis``."""
    upper = lambda k: f"m20 + {k}::double * d20"
    lower = lambda k: f"m20 - {k}::double * d20"
    of = lambda i, template, buy, sell: f"select symbol, bar_ts, \"close\", {i} param_id, '{template}' template, {signal(buy, sell)} signal from sides"
    each = [
        of(0, "ema_cross", up("e5", "e20"), down("e5", "e20")), of(1, "ema_cross", up("e10", "e20"), down("e10", "e20")),
        of(2, "rsi", "rsi < 40", "rsi > 60"), of(3, "rsi", "rsi < 45", "rsi > 60"),
        of(4, "bands", f"{C} < {lower(1.0)}", f"{C} > {upper(1.0)}"), of(5, "bands", f"{C} < {lower(1.5)}", f"{C} > {upper(1.5)}"),
    ]
    return [
        *[c for n in (5, 10, 20) for c in ema(f"x{n}", "numbered", C, span(n), f"e{n}")],
        f"ind as (select r.*, e5, e10, e20, {full(20, SMA20)} m20, {full(20, SD20)} d20 from rsis r join x5 using (symbol, i) join x10 using (symbol, i) join x20 using (symbol, i))",
        f"sides as (select *, {', '.join(f'{lag(c)} prev_{c}' for c in ('e5', 'e10', 'e20'))} from ind)",
        "tried as (" + " union all ".join(each) + ")",
    ]


FOLDS = """num as (select *, row_number() over (partition by symbol order by bar_ts) - 1 idx, count(*) over (partition by symbol) n from bars),
sized as (select *, n // 5 size, trunc((n // 5)::double / (1.0::double - 0.7::double))::bigint total from num),
fold0 as (select *, fold * size st, least(fold * size + trunc(total * 0.7::double)::bigint, n) cut, least(fold * size + total, n) en from sized, (select unnest(range(5)) fold)),
parts as (select symbol, bar_ts, "close", fold, case when idx < cut then 'train' else 'test' end part from fold0 where idx >= st and idx < en and cut - st >= 30 and en - cut >= 10)"""

TOKENS = "regexp_extract_all(lower(text), '([一-鿿]|[a-z]+|\\d+)', 1)"
MIXED = "list_distinct(list_concat(regexp_extract_all(lower({t}), '([一-鿿]+|[a-z]+|\\d+)', 1), regexp_extract_all(lower({t}), '([一-鿿])', 1)))"
PAIRS = "pairs as (select a.conv_id, a.turn, b.text question, a.text answer from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1 where a.role = 'assistant' and b.role = 'user')"
VECTORS = """v as (select vec_id, embedding::double[] e from embeddings),
q as (select vec_id query_id, e qe from v where vec_id % 50 = 0),
s as (select query_id, vec_id, list_sum(list_transform(list_zip(e, qe), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(qe, lambda x: x * x)))) score
  from q join v on v.vec_id <> q.query_id),
t as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) rank from s)"""
BM25 = f"""d as (select doc_id, {TOKENS} k from documents), st as (select count(*) n, avg(len(k)) mean from d),
qt as (select item_id, token, count(*) qn from (select item_id, unnest({TOKENS}) token from benchmark) group by 1, 2),
tf as (select doc_id, len, token, count(*) tf from (select doc_id, len(k) len, unnest(k) token from d) group by 1, 2, 3),
df as (select token, count(*) df from tf group by 1),
w as (select item_id, doc_id, sum(qn * ln((n - df + 0.5::double) / (df + 0.5::double) + 1.0) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len / mean))) score
  from tf join df using (token) join qt using (token), st group by 1, 2),
top as (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) rank from w)"""


JACCARD = "case when len({a}) = 0 or len({b}) = 0 then 0.0::double else len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) end"
#: Cosine of bigram counts for each turn of ``pairs``.
SIMILAR = f"""g as (select conv_id, turn, side, case when length(t) < 2 then null else substring(t, i::int, 2) end g from
  (select conv_id, turn, 0 side, lower(question) t, unnest(range(1, greatest(length(question), 2))) i from pairs union all select conv_id, turn, 1, lower(answer), unnest(range(1, greatest(length(answer), 2))) from pairs)),
c as (select conv_id, turn, g, count(*) filter (side = 0) x, count(*) filter (side = 1) y from g where g is not null group by 1, 2, 3),
likes as (select p.conv_id, p.turn, case when coalesce(sum(x * x), 0) = 0 or coalesce(sum(y * y), 0) = 0 then 0.0::double else sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) end s from pairs p left join c on p.conv_id = c.conv_id and p.turn = c.turn group by 1, 2)"""
#: The five best documents of each benchmark item with their contents, and whether they are relevant.
HITS = f"""{BM25}, hits as (select item_id, rank, text content from top join documents using (doc_id) where rank <= 5),
marked as (select h.*, {JACCARD.format(a="a", b="b")} > 0.1::double relevant from (select h.*, {MIXED.format(t="h.content")} a, {MIXED.format(t="i.text")} b from hits h join benchmark i using (item_id)) h)"""


def screens() -> dict[str, str]:
    """Screens by name: conditions as (label, CTEs, source, test), judged on the last bar of the last ``days``."""
    mid, dev = full(20, SMA20), full(20, SD20)
    wilder = [NUMBERED, MOVES, *ema("eg", "moves", "g", 1 / 14, "ag"), *ema("el", "moves", "l", 1 / 14, "al"), f"w as (select n.*, case when i > 14 and n > 14 then {rsi('ag', 'al')} end rsi from numbered n left join eg using (symbol, i) left join el using (symbol, i))", f"wp as (select *, {lag('rsi')} prev_rsi from w)"]
    macd = [*MACD_CTES, "mg as (select symbol, bar_ts, i, case when n >= 26 then macd end macd, case when n >= 26 then macd_signal end macd_signal from lines)", f"mp as (select *, {lag('macd')} prev_macd, {lag('macd_signal')} prev_macd_signal from mg)"]
    sma = [f"sm as (select *, {mid} m from bars)", f"sp as (select *, {C} c, {lag(C)} prev_c, {lag('m')} prev_m from sm)"]
    emas = [NUMBERED, *ema("ee", "numbered", C, span(20), "v"), "eo as (select n.*, case when n >= 20 then v end m from numbered n join ee using (symbol, i))"]
    boll = [f"bo as (select *, {mid} - 2.0 * {dev} lower from bars)"]
    kdj = [
        NUMBERED,
        f"rsv as (select *, {full(9, f'case when max(high) over {r(9)} = min(low) over {r(9)} then 50.0::double else ({C} - min(low) over {r(9)}) / nullif(max(high) over {r(9)} - min(low) over {r(9)}, 0) * 100.0 end', 'high')} rsv from numbered)",
        *ema("kk", "rsv", "rsv", 1 / 3, "k"),
        *ema("dd", "kk", "k", 1 / 3, "d"),
        "kj as (select n.symbol, n.bar_ts, kk.k, dd.d from numbered n left join kk using (symbol, i) left join dd using (symbol, i))",
        f"kp as (select *, {lag('k')} prev_k, {lag('d')} prev_d from kj)",
    ]
    rsi_at = lambda label, test: (label, wilder, "wp", test)
    price = lambda v: (f"PRICE above {v:g}", [], "bars", f"{C} > {v}")

    def screen(*conditions: tuple, days: int = 365, more: dict[str, tuple[list[str], str, str]] | None = None) -> str:
        ctes = list(dict.fromkeys(x for _, made, _, _ in conditions for x in made))
        raw = HOURLY.replace("bars as", "raw as", 1).replace("event_type symbol", "event_type || '-' || user_id % 8 symbol", 1)
        cut = f"bars as (select * from raw qualify row_number() over (partition by symbol order by bar_ts desc) <= {days})"
        last = [f"c{i} as (select symbol, coalesce({test}, false) ok{', ' + (more or {}).get(label, ([], '', ''))[1] if label in (more or {}) else ''} from {source} qualify row_number() over (partition by symbol order by bar_ts desc) = 1)" for i, (label, _, source, test) in enumerate(conditions)]
        sizes = 'z as (select symbol, count(*) nb, arg_max("close", bar_ts) lc from bars group by 1)'
        said = " || '; ' || ".join(f"'{label}: ' || case when c{i}.ok then 'yes' else 'no' end" for i, (label, *_) in enumerate(conditions))
        joins = " ".join(f"join c{i} on c{i}.symbol = z.symbol" for i in range(len(conditions)))
        extra = ", round(z.lc, 4) \"close\", " + ", ".join(f"round({name}, 4) {name}" for _, _, name in more.values()) if more else ""
        matched = " and ".join(["nb >= 5", *[f"c{i}.ok" for i in range(len(conditions))]])
        return f"with recursive {', '.join([raw, cut, *ctes, *last, sizes])} select z.symbol, {matched} matched, case when nb >= 5 then {said} else 'Insufficient data.' end explanation{extra} from z {joins}"

    above = ("SMA above", sma, "sp", "c > m")
    return {
        "screen_flagship": screen(above, rsi_at("RSI below 70", "rsi < 70"), more={"SMA above": ([], "m sma", "sma"), "RSI below 70": ([], "rsi", "rsi")}),
        "screen_rsi": screen(rsi_at("RSI below 50", "rsi < 50")),
        "screen_rsi_level": screen(rsi_at("RSI crossover", "rsi > 50 and prev_rsi <= 50"), rsi_at("RSI above 50", "rsi > 50")),
        "screen_macd": screen(("MACD above", macd, "mp", "macd > macd_signal")),
        "screen_macd_crosses": screen(("MACD crossover", macd, "mp", up("macd", "macd_signal")), ("EMA above", emas, "eo", f"{C} > m")),
        "screen_ma_boll_and": screen(("MA below", sma, "sp", "c < m"), ("BOLL below", boll, "bo", f"{C} < lower")),
        "screen_ma_crossunder": screen(("SMA crossunder", sma, "sp", down("c", "m"))),
        "screen_kdj": screen(("KDJ above 50", kdj, "kp", "k > 50")),
        "screen_kdj_crosses": screen(("KDJ crossunder", kdj, "kp", down("k", "d"))),
        "screen_price": screen(price(20)),
        "screen_unknown": screen(("NOSUCH above 1", [], "bars", "false"), price(0)),
        "screen_few_bars": screen(price(0), days=4),
        "screen_phrase": screen(rsi_at("RSI below 60", "rsi < 60"), price(5), days=60),
    }


def diagnoses_sql(bt: str) -> str:
    """The second rating scale over metrics in percent."""
    from barloom.operators.metrics import ADVICE, RECOVERY_ADVICE, SOLID, STRONG, WEAK

    scale = {
        "sharpe_ratio": "case when sharpe_ratio > 1.5 then 'good' when sharpe_ratio > 0.5 then 'acceptable' when sharpe_ratio >= 0 then 'poor' else 'critical' end",
        "annual_return": "case when annual_return > 20 then 'good' when annual_return > 5 then 'acceptable' when annual_return > 0 then 'poor' else 'critical' end",
        "max_drawdown": "case when abs(max_drawdown) < 10 then 'good' when abs(max_drawdown) < 20 then 'acceptable' when abs(max_drawdown) < 30 then 'poor' else 'critical' end",
        "win_rate": "case when win_rate > 50 then 'good' when win_rate > 40 then 'acceptable' else 'poor' end",
        "total_trades": "case when total_trades >= 30 then 'acceptable' else 'poor' end",
    }
    tests = ("abs(max_drawdown) >= 20", "abs(max_drawdown) >= 30", "win_rate < 40", "sharpe_ratio < 0.5", "annual_return < 5", "total_trades < 30")
    value = lambda m: "abs(max_drawdown)" if m == "max_drawdown" else f"{m}::double"
    said = lambda table, names: "concat_ws('|', " + ", ".join(f"case when second_{m} in ({names}) then printf('{t}', {value(m)}) end" for m, t in table.items()) + ")"
    advice = "concat_ws('|', " + ", ".join(f"case when {t} then '{a[1]}' end" for t, a in zip(tests, ADVICE, strict=True)) + f", case when max_drawdown_bars > 180 then printf('{RECOVERY_ADVICE}', max_drawdown_bars) end)"
    score = "round(greatest(0.0, least(30.0::double, sharpe_ratio / 2 * 30)) + greatest(0.0, least(25.0::double, annual_return / 30 * 25)) + greatest(0.0, least(25.0::double, (1 - abs(max_drawdown) / 50) * 25)) + greatest(0.0, least(20.0::double, win_rate / 100 * 20)), 1)"
    pct = "pct as (select symbol, sharpe_ratio, annual_return * 100.0::double annual_return, max_drawdown * 100.0::double max_drawdown, win_rate * 100.0::double win_rate, total_trades, max_drawdown_bars from bt)"
    named = "sec as (select *, " + ", ".join(f"{v} second_{m}" for m, v in scale.items()) + " from pct)"
    return f"with recursive {bt}, {pct}, {named} select symbol, {', '.join(f'second_{m}' for m in scale)}, {score} score, {said(STRONG, chr(39) + 'good' + chr(39))} strengths, {said(WEAK, chr(39) + 'poor' + chr(39) + ', ' + chr(39) + 'critical' + chr(39))} weaknesses, case when {advice} = '' then '{SOLID}' else {advice} end suggestions from sec"


def engine_sql() -> str:
    w = "(partition by symbol order by bar_ts rows between unbounded preceding and current row)"
    base = ", ".join([TREND, *SIGNALLED, *backtest(commission=0.0003)])
    return f"""with recursive {base}, lagged as (select *, exp({lag('le')}) bef from eq), opened as (select *, last_value(case when entry then coalesce(bef, 100000.0::double) end ignore nulls) over {w} op from lagged),
pl as (select symbol, exp(le) - op pnl, (exp(le) - op) / 100000.0::double rr from opened where ext),
t as (select symbol, count(*) total_trades, count(*) filter (pnl > 0) won_trades, count(*) filter (pnl < 0) lost_trades, avg(pnl) filter (pnl > 0) gain, abs(avg(pnl) filter (pnl < 0)) loss, avg(rr) mr, stddev_samp(rr) sr, stddev_samp(rr) filter (rr < 0) dn from pl group by 1),
b as (select symbol, count(*) n_bars from bars group by 1),
u as (select b.symbol, n_bars, coalesce(t.total_trades, 0) total_trades, coalesce(won_trades, 0) won_trades, coalesce(lost_trades, 0) lost_trades, max_drawdown_bars, total_return, annual_return, sharpe_ratio, max_drawdown,
  coalesce(won_trades / t.total_trades::double, 0) win_rate, coalesce(case when coalesce(loss, 0) > 0 then coalesce(gain, 0) / loss when gain > 0 then 'inf'::double else 0 end, 0) profit_factor,
  coalesce(case when (case when lost_trades = 0 then 0.0001::double else coalesce(dn, 0) end) > 0 then mr / (case when lost_trades = 0 then 0.0001::double else dn end) else 0 end, 0) sortino_ratio, coalesce(sr, 0) volatility,
  case when max_drawdown > 0 and coalesce(t.total_trades, 0) > 0 then annual_return / max_drawdown else 0 end calmar_ratio from b join bt using (symbol) left join t using (symbol))
select symbol, n_bars, """ + ", ".join(f"case when n_bars >= 50 then {c} else 0 end::bigint {c}" for c in ("total_trades", "won_trades", "lost_trades", "max_drawdown_bars")) + ", " + ", ".join(f"{six(f'case when n_bars >= 50 then {c} else 0 end')} {c}" for c in ("total_return", "annual_return", "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor", "sortino_ratio", "volatility", "calmar_ratio")) + " from u"  # fmt: skip


def evaluation_sql() -> dict[str, str]:
    per = "per as (select item_id, count(*) filter (relevant) h, min(rank) filter (relevant) f from marked group by 1)"
    sources = "case when length(content) > 100 then substring(content, 1, 100) || '...' else content end"
    return {
        "relevant_hits": f"with {HITS} select item_id query_id, rank::int rank, relevant from marked",
        "retrieval_evaluation": f"with {HITS}, {per}, e as (select item_id, coalesce(h, 0) h, f from benchmark left join per using (item_id)) select round(avg(h / 5.0::double), 4) precision_at_k, round(avg(h::double), 4) recall_at_k, round(avg(coalesce(1.0::double / f, 0)), 4) mrr, count(*) num_queries from e",
        "answer_evaluation": f"with {PAIRS}, {SIMILAR}, t as (select conv_id, turn, {MIXED.format(t='answer')} a, {MIXED.format(t='(question || chr(32) || substring(answer, 1, (length(answer) // 2)::int))')} b from pairs), j as (select conv_id, turn, {JACCARD.format(a='a', b='b')} f from t) select conv_id, turn, {six('f')} faithfulness, {six('s')} relevancy, {six('0.5::double * f + 0.5::double * s')} overall from j join likes using (conv_id, turn)",
        "full_evaluation": f"""with {HITS}, {per}, ctx as (select item_id, string_agg(content, ' ' order by rank) ctx, max(content) filter (rank = 1) answer from hits group by 1),
x as (select item_id, coalesce(h, 0) h, f, {MIXED.format(t='answer')} a, {MIXED.format(t='ctx')} b, string_split(i.text, ' ')[1:2] kw, answer from benchmark i join ctx using (item_id) left join per using (item_id)),
y as (select *, {JACCARD.format(a='a', b='b')} fa, len(list_filter(kw, lambda w: contains(answer, lower(w)))) / len(kw)::double re from x)
select count(*) total_cases, round(avg(h / 5.0::double), 4) precision_at_k, round(avg(h::double), 4) recall_at_k, round(avg(coalesce(1.0::double / f, 0)), 4) mrr, round(avg(fa), 4) faithfulness, round(avg(re), 4) relevancy, round((avg(fa) + avg(re)) / 2, 4) overall from y""",
        "context": f"with {BM25} select item_id query_id, md5(string_agg('[' || rank || '] (来源: doc' || rank || ', 页码: ' || rank || ')' || chr(10) || text, chr(10) || chr(10) order by rank)) digest from top join documents using (doc_id) where rank <= 5 group by 1",
        "source_list": f"with {HITS} select item_id query_id, md5('来源列表:' || chr(10) || repeat('=', 50) || chr(10) || string_agg(chr(10) || '[' || rank || ']' || chr(10) || '  来源: corpus' || chr(10) || '  标题: corpus' || chr(10) || '  内容: ' || {sources}, chr(10) order by rank)) digest from hits group by 1",
        "rerank_topk": f"""with {BM25}, c as (select item_id q, doc_id, round(round(score, 9), 6) / 100 score, rank pos, regexp_extract_all(lower(b.text), '([a-z0-9]+)', 1) qk, regexp_extract_all(lower(d.text), '([a-z0-9]+)', 1) k from top join documents d using (doc_id) join benchmark b using (item_id) where rank <= 10),
z as (select *, len(k) len, count(*) over (partition by q) n, avg(len(k)) over (partition by q) mean from c),
rtf as (select q, doc_id, len, n, mean, token, count(*) tf from (select q, doc_id, len, n, mean, unnest(k) token from z) group by all),
rdf as (select *, count(*) over (partition by q, token) df from rtf), rq as (select q, doc_id, token, count(*) qn from (select q, doc_id, unnest(qk) token from z) group by all),
bm as (select q, doc_id, sum(qn * ln((n - df + 0.5::double) / (df + 0.5::double) + 1.0) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len / mean))) bm from rdf join rq using (q, doc_id, token) group by 1, 2),
f as (select z.q, z.doc_id, pos, round(0.7::double * coalesce(bm, 0) + 0.3::double / (1 + exp(-score)), 9) score from z left join bm using (q, doc_id))
select q query_id, (row_number() over (partition by q order by score desc, pos))::int rank, doc_id, {six('score')} score from f qualify row_number() over (partition by q order by score desc, pos) <= 5""",
        "hybrid_topk": f"""with {VECTORS}, h as (select query_id, vec_id, 1 - score d, max(1 - score) over (partition by query_id) far from t where rank <= 30),
m as (select query_id, vec_id doc_id, d, case when far > 0 then 1 - d / nullif(far, 0) else 1.0 end v, list_distinct({TOKENS.replace('text', 'qd.text')}) qk, {TOKENS.replace('text', 'hd.text')} k, substring(hd.text, 1, 100) head from h join documents hd on hd.doc_id = vec_id join documents qd on qd.doc_id = query_id),
o as (select *, round(0.7::double * v + (1 - 0.7::double) * case when len(qk) = 0 then 0.0 else len(list_intersect(qk, k))::double / len(qk) end, 9) score from m qualify row_number() over (partition by query_id, head order by d, doc_id) = 1),
p as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from o) select query_id, rank::int rank, doc_id, {six('score')} score from p where rank <= 10""",
        "mmr_topk": f"""with recursive {VECTORS}, pool as (select query_id, vec_id, score rel, e from t join v using (vec_id) where rank <= 20),
sims as (select a.query_id, a.vec_id x, b.vec_id y, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a.e, lambda z: z * z))) * sqrt(list_sum(list_transform(b.e, lambda z: z * z)))) sim from pool a join pool b on a.query_id = b.query_id),
steps as (select query_id, 0 step, []::bigint[] chosen, null::bigint pick from (select distinct query_id from pool) union all
  select query_id, step + 1, list_append(chosen, best), best from (
    select query_id, step, chosen, arg_max(vec_id, {{'g': gain, 'i': -vec_id}}) best from (
      select s.query_id, s.step, s.chosen, p.vec_id, case when s.step = 0 then p.rel else 0.5::double * p.rel - 0.5::double * max(m.sim) end gain
      from steps s join pool p on p.query_id = s.query_id and not list_contains(s.chosen, p.vec_id) left join sims m on m.query_id = s.query_id and m.x = p.vec_id and list_contains(s.chosen, m.y)
      where s.step < 5 group by s.query_id, s.step, s.chosen, p.vec_id, p.rel) group by query_id, step, chosen))
select s.query_id, step::int rank, pick vec_id, {six('1 - rel')} distance from steps s join pool p on p.query_id = s.query_id and p.vec_id = s.pick where step > 0""",
        "chunk_clauses": r"""with d as (select conv_id, string_agg(case when turn % 3 = 0 then '第' || (turn + 1) || '條 ' else 'ARTICLE ' || (turn + 1) || chr(10) end || substring(text, 1, 300), chr(10) order by turn) text from conversations group by 1),
s as (select conv_id, string_split(regexp_replace(text, '(^|\n)(第[一二三四五六七八九十百千零\d]+[條章節款項]|Article\s+\d+|Section\s+\d+|\d+\.\s+)', '\1' || chr(1) || '\2', 'gi'), chr(1)) parts from d),
u as (select conv_id, unnest(parts) raw, generate_subscripts(parts, 1) i from s),
o as (select *, sum(length(raw)) over (partition by conv_id order by i) - length(raw) off, regexp_replace(raw, '^\s+|\s+$', '', 'g') piece from u)
select conv_id, (row_number() over (partition by conv_id order by i) - 1)::int pos, md5(piece) digest, (off + length(raw) - length(regexp_replace(raw, '^\s+', '')))::int start_idx, (off + length(raw) - length(regexp_replace(raw, '^\s+', '')) + length(piece))::int end_idx,
  conv_id || '::chunk_' || (row_number() over (order by conv_id, i) - 1) || '_' || substring(md5(piece), 1, 8) chunk_id from o where piece <> ''""",
        "labels_matched": """with n as (select doc_id, ['bullish', 'bearish', 'neutral'] names from documents),
t as (select doc_id, names[(doc_id % 2 + 1)::int] wanted, case when doc_id % 11 = 0 then 'no view' else 'It looks ' || names[(doc_id % 3 + 1)::int] || case when doc_id % 5 = 0 then ', not bullish' else '' end end said from n),
l as (select *, case when contains(said, 'bullish') then 'bullish' when contains(said, 'bearish') then 'bearish' when contains(said, 'neutral') then 'neutral' end label from t)
select doc_id, label, coalesce(contains('sentiment: ' || wanted, label), false) correct from l""",
    }


def semantic_chunks(most: int = 1000, least: int = 50) -> str:
    """Sentences grouped by neighbours' bigrams, long groups cut by ever finer separators, short ones joined to the chunk before."""
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    ctes = [
        rf"""l as (select doc_id, text, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?。！？；\n])\s*', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '') l from documents)""",
        "s as (select doc_id, unnest(l) s, generate_subscripts(l, 1) i from l where len(l) > 1)",
        "b as (select doc_id, i, substring(lower(s), unnest(range(1, length(s)))::int, 2) b from s)",
        "c as (select doc_id, i, b, count(*) n from b group by all)",
        "q as (select doc_id, i, sum(n * n) q from c group by all)",
        "d as (select x.doc_id, x.i, sum(x.n * y.n) d from c x join c y on x.doc_id = y.doc_id and y.i = x.i - 1 and x.b = y.b group by all)",
        "f as (select s.doc_id, s.i, s.s, case when coalesce(d.d::double / sqrt((q.q * p.q)::double), 0) < 0.5::double then 1 else 0 end new from s left join d using (doc_id, i) left join q using (doc_id, i) left join q p on p.doc_id = s.doc_id and p.i = s.i - 1)",
        "g as (select *, sum(new) over (partition by doc_id order by i) g from f)",
        "l0 as (select doc_id, [g::bigint] path, string_agg(s, ' ' order by i) t from g group by doc_id, g)",
    ]
    for k, sep in enumerate(("。", "，", ". ", " ")):
        fits = f"length(r.held) + {len(sep)} + length(p.part) <= {most}"
        cut = f"length(t) > {most} and contains(t, '{sep}')"
        ctes += [
            f"p{k} as (select doc_id, path, unnest(string_split(t, '{sep}')) part, generate_subscripts(string_split(t, '{sep}'), 1) j from l{k} where {cut})",
            f"r{k} as (select doc_id, path, j, part held, null::varchar given from p{k} where j = 1 union all "
            f"select p.doc_id, p.path, p.j, case when {fits} then r.held || '{sep}' || p.part else p.part end, case when {fits} then null else r.held end from r{k} r join p{k} p on p.doc_id = r.doc_id and p.path = r.path and p.j = r.j + 1)",
            f"e{k} as (select doc_id, path, j, given t from r{k} where given is not null union all select doc_id, path, max(j) + 1, arg_max(held, j) from r{k} group by doc_id, path)",
            f"l{k + 1} as (select doc_id, path, t from l{k} where not ({cut}) union all select doc_id, list_append(path, j), {strip('t')} from e{k} where {strip('t')} <> '')",
        ]
    ctes += [
        f"w as (select doc_id, path, t from l4 where length(t) <= {most} union all select doc_id, list_append(path, k), {strip(f'substring(t, (k + 1)::int, {most})')} from (select doc_id, path, t, unnest(range(0, length(t), {most})) k from l4 where length(t) > {most}))",
        f"i as (select doc_id, t, len(path) = 1 and length(t) < {least} short, row_number() over (partition by doc_id order by path) n from w where t <> '')",
        f"j as (select doc_id, n, 0 pos, t chunk from i where n = 1 union all select i.doc_id, i.n, case when short and length(chunk) + 1 + length(t) <= {most} then pos else pos + 1 end, "
        f"case when short and length(chunk) + 1 + length(t) <= {most} then chunk || ' ' || t else t end from j join i on i.doc_id = j.doc_id and i.n = j.n + 1)",
    ]
    return f"with recursive {', '.join(ctes)} select doc_id, pos, arg_max(chunk, n) chunk from j group by doc_id, pos union all select doc_id, 0, {strip('text')} from l where len(l) <= 1 and {strip('text')} <> ''"


def oracle_sql() -> dict[str, str]:
    mid, dev = full(20, SMA20), full(20, SD20)
    boll = f"b as (select *, {mid} mid, {dev} sd from bars)"
    hi, lo = HL
    kd = [
        NUMBERED,
        f"rsv as (select *, {full(9, f'case when max(high) over {r(9)} = min(low) over {r(9)} then 50.0::double else ({C} - min(low) over {r(9)}) / nullif(max(high) over {r(9)} - min(low) over {r(9)}, 0) * 100.0 end', 'high')} rsv from numbered)",
        *ema("kk", "rsv", "rsv", 1 / 3, "k"),
        *ema("dd", "kk", "k", 1 / 3, "d"),
        "kdj as (select n.symbol, n.bar_ts, kk.k, dd.d from numbered n left join kk using (symbol, i) left join dd using (symbol, i))",
    ]
    emas = [NUMBERED, *ema("e", "numbered", C, span(20), "v"), "out as (select n.*, e.v from numbered n join e using (symbol, i))"]
    wilder = [NUMBERED, MOVES, *ema("eg", "moves", "g", 1 / 14, "ag"), *ema("el", "moves", "l", 1 / 14, "al"), "out as (select n.*, ag, al from numbered n left join eg using (symbol, i) left join el using (symbol, i))"]
    spanned = [
        NUMBERED,
        MOVES,
        "zero as (select symbol, i, coalesce(g, 0) g, coalesce(l, 0) l from moves)",
        *ema("eg", "zero", "g", span(14), "ag"),
        *ema("el", "zero", "l", span(14), "al"),
        "out as (select n.*, ag, al from numbered n join eg using (symbol, i) join el using (symbol, i))",
    ]
    atr = lambda n: [NUMBERED, MOVES, *ema("ea", "moves", "tr", span(n), "a"), "out as (select n.*, a from numbered n join ea using (symbol, i))"]
    keltner = [NUMBERED, MOVES, *ema("ea", "moves", "tr", span(10), "a"), *ema("em", "moves", C, span(20), "m"), "out as (select n.*, a, m from numbered n join ea using (symbol, i) join em using (symbol, i))"]
    crossing = f"x as (select *, {full(20, SMA20)} m from bars), y as (select *, {C} c, {lag(C)} prev_c, {lag('m')} prev_m from x)"
    stoch = f"k as (select *, {full(14, f'100.0 * ({C} - {lo}) / nullif({hi} - {lo}, 0)', 'high')} sk from bars)"
    bollrsi = [*RSI14, f"br as (select *, {mid} mid, {dev} sd from rsis)"]
    ma = [
        NUMBERED, *ema("ef", "numbered", C, span(10), "f"), *ema("es", "numbered", C, span(30), "s"),
        "m as (select n.*, f, s from numbered n join ef using (symbol, i) join es using (symbol, i))",
        f"mp as (select *, {lag('f')} prev_f, {lag('s')} prev_s from m)",
    ]
    macdp = [*MACD_CTES, f"mp as (select *, {lag('macd')} prev_macd, {lag('macd_signal')} prev_macd_signal from lines)"]
    dual = f"dt as (select *, {full(5, f'greatest(max(high) over {r(4)} - min({C}) over {r(4)}, max({C}) over {r(4)} - min(low) over {r(4)})')} reach from bars)"
    sig = lambda ctes, source, buy, sell: shown({"signal": f"({signal(buy, sell)})::int"}, *ctes, source=source)
    bt = ", ".join([TREND, *SIGNALLED, *backtest()])
    search_sql = ", ".join([TREND, *RSI14, *search_signals(), *backtest("symbol, param_id, template", "tried")])
    def searched(pairs: list[tuple[int, int]]) -> str:
        ctes = [x for i, (f, s) in enumerate(pairs) for x in cross_signals(f, s, "symbol", "bars", f"g{i}")]
        union = "gs as (" + " union all ".join(f"select symbol, bar_ts, {C}, {i} param_id, signal from g{i}" for i in range(len(pairs))) + ")"
        return ", ".join([TREND, *ctes, union, *backtest("symbol, param_id", "gs")])

    grid_sql = searched([(f, s) for f in (5, 10) for s in (20, 30)])
    random_sql = searched([(p["fast"], p["slow"]) for p in random_combinations({"fast": [3, 15], "slow": [20, 30, 40]}, 4)])
    fold_sql = ", ".join([TREND, FOLDS, *cross_signals(10, 30, "symbol, fold, part", "parts", "fs"), *backtest("symbol, fold, part", "fs")])
    folded = "folded as (select symbol, fold, max(case when part = 'train' then total_return end) tr, max(case when part = 'test' then total_return end) te from bt group by 1, 2)"
    over_sql = ", ".join(
        [
            TREND,
            "parts as (select symbol, bar_ts, \"close\", case when percent_rank() over (partition by symbol order by bar_ts) <= 0.5::double then 'train' else 'test' end part from bars)",
            *cross_signals(5, 20, "symbol, part", "parts", "fs"),
            *backtest("symbol, part", "fs"),
            "pv as (select symbol, " + ", ".join(f"max(case when part = '{p}' then coalesce({m}, 0) end) {p}_{m}" for p in ("train", "test") for m in ("total_return", "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor")) + " from bt group by 1)",
        ]
    )
    over = """least(1.0, case when train_sharpe_ratio > 5 then 0.4 when train_sharpe_ratio > 3 then 0.2 else 0 end::double
  + case when train_total_return > 0 and test_total_return < 0 then case when train_total_return - test_total_return > 0.3::double then 0.4 else 0.25 end when train_sharpe_ratio > 1 and test_sharpe_ratio < 0 then 0.3 else 0 end::double
  + case when train_max_drawdown > 0 and test_max_drawdown > train_max_drawdown * 2.5::double then 0.2 when train_max_drawdown > 0 and test_max_drawdown > train_max_drawdown * 1.8::double then 0.1 else 0 end::double
  + case when train_win_rate > 0.6::double and test_win_rate < 0.4::double then 0.15 else 0 end::double
  + case when train_profit_factor > 2 and test_profit_factor < 1 then 0.15 else 0 end::double)"""
    ret = f"ret as (select symbol, bar_ts, {C} / {lag(C)} - 1.0 r from bars), retn as (select *, exp(sum(ln(1.0 + r)) over (partition by symbol order by bar_ts rows unbounded preceding)) v from ret where r is not null), retd as (select *, v / max(v) over (partition by symbol order by bar_ts rows unbounded preceding) - 1.0 dd from retn)"
    found: dict[str, str] = {
        "bars_hourly": f"with {HOURLY} select * from bars",
        "bars_orders_daily": f"with {ORDERS} select * from bars",
        "last_bars": f"with {HOURLY} select symbol, bar_ts, {C} from bars qualify row_number() over (partition by symbol order by bar_ts desc) <= 30",
        "symbols": "select distinct event_type symbol from events",
        "sma20": shown({"sma": six(mid)}),
        "sma20_partial": shown({"sma": six(SMA20)}),
        "wma10": shown({"wma": six("case when count(*) over " + r(10) + " = 10 then (" + " + ".join(f"{10 - k} * lag({C}, {k}) over {ORDER}" for k in range(10)) + ") / 55.0 end")}),
        "bollinger20": shown({"boll_mid": six("mid"), "boll_upper": six("mid + 2.0 * sd"), "boll_lower": six("mid - 2.0 * sd")}, boll, source="b"),
        "bollinger_bandwidth": shown({"boll_bandwidth": six("4.0 * sd / nullif(mid, 0)")}, boll, source="b"),
        "bollinger_pct_b": shown({"boll_pct_b": six(f"({C} - (mid - 2.0 * sd)) / nullif((mid + 2.0 * sd) - (mid - 2.0 * sd), 0)")}, boll, source="b"),
        "stochastic14": shown({"stoch_k": six("sk"), "stoch_d": six(full(3, f"avg(sk) over {r(3)}", "sk"))}, stoch, source="k"),
        "williams_r14": shown({"williams_r": six(full(14, f"-100.0 * ({hi} - {C}) / nullif({hi} - {lo}, 0)", "high"))}),
        "atr_sma14": shown({"atr": six(full(14, f"avg(tr) over {r(14)}", "tr"))}, NUMBERED, MOVES, source="moves"),
        "donchian": shown({"don_upper": six("u"), "don_lower": six("d"), "don_mid": six("(u + d) / 2.0")}, *BREAK, source="brk"),
        "breakout": shown({"breakout_up": "bu", "breakout_down": "bd"}, *BREAK, source="brk"),
        "zscore20": shown({"zscore": six(full(20, f"({C} - {SMA20}) / nullif({SD20}, 0)"))}),
        "rsi_sma14": shown({"rsi": six("rsi")}, *RSI14, source="rsis"),
        "ema20": shown({"ema": six("case when n >= 20 then v end")}, *emas, source="out"),
        "macd": shown({k: six(f"case when n >= 26 then {v} end") for k, v in (("macd", "macd"), ("macd_signal", "macd_signal"), ("macd_hist", "macd - macd_signal"))}, *MACD_CTES, source="lines"),
        "rsi_wilder14": shown({"rsi": six("case when i > 14 and n > 14 then " + rsi("ag", "al") + " end")}, *wilder, source="out"),
        "rsi_span14": shown({"rsi": six(rsi("ag", "al"))}, *spanned, source="out"),
        "kdj": shown({"k": six("k"), "d": six("d"), "j": six("3.0 * k - 2.0 * d")}, *kd, source="kdj"),
        "atr_ema14": shown({"atr": six("a")}, *atr(14), source="out"),
        "keltner": shown({"kelt_mid": six("m"), "kelt_upper": six("m + 2.0 * a"), "kelt_lower": six("m - 2.0 * a")}, *keltner, source="out"),
        "returns": shown({"ret": six(f"{C} / {lag(C)} - 1.0")}),
        "cross_sma": shown({"crossover": up("c", "m"), "crossunder": down("c", "m")}, crossing, source="y"),
        "patterns": shown(PATTERNS, CANDLES, source="c"),
        "pattern_summary": f"with {HOURLY}, {CANDLES} " + " union all ".join(f"select symbol, '{k}' pattern, sum(({v})::int)::bigint n from c group by 1" for k, v in PATTERNS.items()),
        "signals_momentum_breakout": sig(BREAK, "brk", "bu", "bd"),
        "signals_turtle_trading": sig(BREAK, "brk", "bu", "bd"),
        "signals_dual_ma_crossover": sig(ma, "mp", up("f", "s"), down("f", "s")),
        "signals_bollinger_rsi": sig(bollrsi, "br", f"{C} <= mid - 2.0 * sd and rsi < 30", f"{C} >= mid + 2.0 * sd and rsi > 70"),
        "signals_rsi_extreme": sig(RSI14, "rsis", "rsi < 30", "rsi > 70"),
        "signals_macd_signal": sig(macdp, "mp", up("macd", "macd_signal") + " and macd > 0", down("macd", "macd_signal") + " and macd < 0"),
        "signals_mean_reversion": sig([boll], "b", f"({C} - mid) / nullif(sd, 0) < -2.0", f"({C} - mid) / nullif(sd, 0) > 2.0"),
        "signals_dual_thrust": sig([dual], "dt", f'{C} > "open" + 0.5 * reach', f'{C} < "open" - 0.5 * reach'),
        "signals_bollinger_bounce": sig([boll], "b", f"{C} < mid - 2.0 * sd", f"{C} > mid + 2.0 * sd"),
        "trades": f"with recursive {bt} select symbol, et entry_ts, bar_ts exit_ts, {six('ep')} entry_price, {six(C)} exit_price, {six(f'(({C} - ep) / ep - 2 * 0.001::double) * 100.0')} return_pct, (rn - er)::bigint bars_held from pos where ext",
        "sized_trades": f"with recursive {', '.join([TREND, *SIGNALLED, *sized()])} select symbol, tet entry_ts, xt exit_ts, tsh shares, {six('tep')} entry_price, {six('xp')} exit_price, {six('pnl')} pnl, {six('cash')} cash_after from st where xt is not null",
        "sized_results": f"""with recursive {', '.join([TREND, *SIGNALLED, *sized()])}, l as (select symbol, count(*) n_bars, arg_max("close", bar_ts) last from sig group by 1),
e as (select symbol, count(xt) total_trades, arg_max(cash, n) cash, arg_max(sh, n) shares, count(*) filter (pnl > 0) won from st group by 1),
v as (select *, cash + case when shares > 0 then shares * last else 0.0::double end v from e join l using (symbol))
select symbol, n_bars, total_trades, {six('cash')} cash, shares, {six('v')} "value", {six('v / 1000.0::double - 1.0')} total_return, {six('coalesce(won / nullif(total_trades, 0)::double, 0)')} win_rate from v""",
        "strategy_results": f"""with recursive {HOURLY.replace('bars as', 'raw as', 1)}, bars as (select * exclude (rn) from (select *, row_number() over {ORDER} rn from raw) where rn <= 25 + 5 * length(symbol)), {', '.join([*SIGNALLED, *backtest()])}
select symbol, n n_bars, {', '.join(f'case when n >= 50 then round({c} * 100.0, 2) + 0.0::double else 0.0::double end {c}' for c in ('total_return', 'annual_return', 'max_drawdown', 'win_rate'))},
case when n >= 50 then round(sharpe_ratio, 4) + 0.0::double else 0.0::double end sharpe_ratio, case when n >= 50 then total_trades else 0 end total_trades, case when n >= 50 then max_drawdown_bars else 0 end max_drawdown_bars from bt""",
        "equity_log": f"with recursive {bt} select symbol, bar_ts, {six('le')} log_equity, {six('dd')} drawdown from eq",
        "drawdown_duration": f"with recursive {bt} select symbol, runs max_drawdown_bars from runs",
        "backtest_metrics": f"with recursive {bt} select symbol, total_trades, max_drawdown_bars, {', '.join(f'{six(c)} {c}' for c in BT_COLUMNS)} from bt",
        "ratings": f"with recursive {bt}, {ratings_cte()} select symbol, rating_sharpe_ratio, rating_annual_return, rating_max_drawdown, rating_win_rate, overall_score, total_trades < 30 few_trades from rated",
        "compare_best": f"with recursive {bt}, {ratings_cte()} select symbol best, overall_score best_score from rated order by overall_score desc, symbol limit 1",
        "percent_scores": f"with recursive {bt} select symbol, round(greatest(0.0, least(30.0::double, sharpe_ratio / 2 * 30)) + greatest(0.0, least(25.0::double, annual_return * 100 / 30 * 25)) + greatest(0.0, least(25.0::double, (1 - abs(max_drawdown * 100) / 50) * 25)) + greatest(0.0, least(20.0::double, win_rate * 100 / 100 * 20)), 1) score from bt",
        "return_metrics": f"""with {ORDERS}, {ret}, g as (select symbol, count(*) n, exp(sum(ln(1.0 + r))) gr, stddev_samp(r) sd, avg(r - 0.03::double / {DAYS_A}) ex, stddev_samp(r - 0.03::double / {DAYS_A}) exsd,
  stddev_samp(case when r < 0 then r end) dsd, min(dd) mdd, avg(case when r > 0 then 1.0::double else 0.0::double end) wr, avg(case when r > 0 then r end) mg, avg(case when r < 0 then r end) ml from retd group by 1),
a as (select *, pow(gr, 1.0 / greatest(n / {DAYS_A}.0::double, 0.01::double)) - 1.0 ann from g)
select symbol, n n_returns, {six('gr - 1.0')} total_return, {six('ann')} annual_return, {six(f'sd * sqrt({DAYS_A}.0::double)')} volatility, {six(f'ex / nullif(exsd, 0) * sqrt({DAYS_A}.0::double)')} sharpe_ratio,
  {six(f'(ann - 0.03::double) / (dsd * sqrt({DAYS_A}.0::double))')} sortino_ratio, {six('ann / abs(mdd)')} calmar_ratio, {six('mdd')} max_drawdown, {six('wr')} win_rate, {six('mg / abs(ml)')} profit_factor from a""",
        "grid_search": f"with recursive {grid_sql} select symbol, param_id, {six('coalesce(total_return, 0)')} score from bt",
        "random_search": f"with recursive {random_sql} select symbol, param_id, {six('coalesce(total_return, 0)')} score from bt",
        "search_templates": f"with recursive {search_sql} select symbol, param_id, template, {six('coalesce(total_return, 0)')} score from bt",
        "search_best": f"with recursive {search_sql}, sc as (select symbol, param_id, coalesce(total_return, 0) score from bt) select symbol, arg_max(param_id, {{'s': score, 'i': -param_id}}) param_id, {six('max(score)')} score from sc group by symbol",
        "overfit_report": f"""with recursive {over_sql}, wn as (select symbol, train_sharpe_ratio > 3 a, (train_total_return > 0 and test_total_return < 0) or (train_sharpe_ratio > 1 and test_sharpe_ratio < 0) b,
  train_max_drawdown > 0 and test_max_drawdown > train_max_drawdown * 1.8::double c, train_win_rate > 0.6::double and test_win_rate < 0.4::double d, train_profit_factor > 2 and test_profit_factor < 1 f from pv),
rc as (select symbol, concat_ws(',', case when a then 'sharpe' end, case when b then 'sharpe_cliff' end, case when c then 'drawdown' end, case when d then 'win_rate' end, case when f then 'profit_factor' end) warnings,
  concat_ws('|', case when a then '降低对Sharpe比率的期望，真实市场中2.0以上已属优秀' end, case when b then '使用前向验证 (Walk-Forward) 重新评估策略稳健性|减少策略参数数量，使用更简单的逻辑' end,
  case when c then '增加风险管理规则，如动态止损|在更多历史数据上测试策略，覆盖不同市场环境' end, case when a then '检查是否使用了未来数据（look-ahead bias）|考虑交易成本和滑点的影响' end, case when d then '避免过度优化入场条件|增加样本外验证数据量' end) r from wn)
select symbol, warnings, case when r = '' then '策略表现稳健，建议继续监控实盘表现' else r end recommendations from rc""",
        "diagnoses": diagnoses_sql(bt),
        "engine_metrics": engine_sql(),
        "side_by_side": f"with recursive {bt}, f as (select min(symbol) s1 from bt), g as (select min(symbol) s2 from bt, f where symbol > s1) select m.metric, {six('max(case when symbol = s1 then v end)')} \"first\", {six('max(case when symbol = s2 then v end)')} \"second\" from (select symbol, unnest(['sharpe_ratio', 'annual_return', 'max_drawdown', 'win_rate']) metric, unnest([sharpe_ratio, annual_return, max_drawdown, win_rate]) v from bt) m, f, g group by 1",
        **screens(),
        **evaluation_sql(),
        "grid_search_best": f"with recursive {grid_sql} select symbol, arg_max(param_id, {{'s': coalesce(total_return, 0), 'p': -param_id}}) param_id, {six('max(coalesce(total_return, 0))')} score from bt group by 1",
        "walk_forward_folds": f"with recursive {fold_sql}, {folded} select symbol, fold::int fold, {six('tr')} train_return, {six('te')} test_return from folded",
        "walk_forward_summary": f"with recursive {fold_sql}, {folded}, sm as (select symbol, count(*) n_folds, avg(tr) a, avg(te) b from folded group by 1) select symbol, n_folds, {six('a')} mean_train, {six('b')} mean_test, {six('case when a <> 0 then b / nullif(a, 0) when b = 0 then 0.0 else 1.0 end')} degradation_ratio, (case when a <> 0 then b / nullif(a, 0) when b = 0 then 0.0 else 1.0 end) > 0.5 and b > 0 robust from sm",
        "overfit_score": f"with recursive {over_sql} select symbol, round({over}, 6) overfit_score from pv",
        "document_frequency": f"select token, count(*) df from (select unnest(list_distinct({TOKENS})) token from documents) group by 1",
        "bm25_topk": f"with {BM25} select item_id, rank::int rank, doc_id, {six('round(score, 9)')} score from top where rank <= 10",
        "jaccard_overlap": f"with {PAIRS}, k as (select conv_id, turn, {MIXED.format(t='question')} a, {MIXED.format(t='answer')} b from pairs) select conv_id, turn, {six('case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end')} overlap from k",
        "bigram_cosine": f"with {PAIRS}, {SIMILAR} select conv_id, turn, {six('s')} similarity from likes",
        "cosine_topk": f"with {VECTORS} select query_id, rank::int rank, vec_id, {six('score')} score from t where rank <= 10",
        "ir_metrics": f"""with {VECTORS}, l as (select query_id, rank, (a.label = b.label) rel from t join embeddings a on a.vec_id = query_id join embeddings b on b.vec_id = t.vec_id where rank <= 10),
e as (select q.vec_id query_id, (select count(*) from embeddings o where o.label = q.label) - 1 ne from embeddings q where q.vec_id % 50 = 0),
m as (select e.query_id, ne, coalesce(sum(rel::int) filter (rank <= 5), 0) h, min(case when rel then rank end) filter (rank <= 5) f from e left join l on e.query_id = l.query_id group by 1, 2)
select round(avg(h / 5.0::double), 4) precision_at_k, round(avg(coalesce(h / nullif(ne, 0)::double, 0)), 4) recall_at_k, round(avg(coalesce(1.0::double / f, 0)), 4) mrr from m""",
        "bleu1": f"""with {PAIRS}, w as (select conv_id, turn, list_filter(string_split_regex(question, '\\s+'), lambda x: x <> '') rw, list_filter(string_split_regex(answer, '\\s+'), lambda x: x <> '') hw from pairs),
x as (select conv_id, turn, unnest(rw) w, 1 cr, 0 ch from w union all select conv_id, turn, unnest(hw), 0, 1 from w),
c as (select conv_id, turn, w, sum(cr) cr, sum(ch) ch from x group by 1, 2, 3), m as (select conv_id, turn, sum(least(cr, ch)) m from c group by 1, 2)
select w.conv_id, w.turn, {six('case when len(hw) = 0 then 0.0 else m / len(hw)::double * least(1.0, len(hw)::double / greatest(len(rw), 1)) end')} bleu1 from w left join m on w.conv_id = m.conv_id and w.turn = m.turn""",
        "chunk_hard_cut": "select doc_id, pos::int pos, md5(chunk) digest from (select doc_id, unnest(list_filter([regexp_replace(substring(text, (i + 1)::int, 500), '^\\s+|\\s+$', '', 'g') for i in range(0, greatest(length(text), 1), 450)], lambda s: s <> '')) chunk, generate_subscripts(list_filter([regexp_replace(substring(text, (i + 1)::int, 500), '^\\s+|\\s+$', '', 'g') for i in range(0, greatest(length(text), 1), 450)], lambda s: s <> ''), 1) - 1 pos from documents)",
        "chatml": "select conv_id, count(*) n_messages, string_agg(role || ':' || md5(text), ',' order by turn) digest from conversations group by 1",
        "alpaca": f"with {PAIRS} select conv_id, turn, md5('Answer the question.' || '|' || question || '|' || answer) digest from pairs",
        "train_test_split": "select doc_id, case when row_number() over (order by md5(doc_id::varchar)) <= greatest(1, floor(count(*) over () * (1 - 0.1::double))) then 'train' else 'test' end part from documents",
        "chunk_semantic": semantic_chunks(),
        "chunk_ids": r"""with p as (select doc_id, unnest(l) chunk, generate_subscripts(l, 1) i from (select doc_id, [regexp_replace(substring(text, (k + 1)::int, 1000), '^\s+|\s+$', '', 'g') for k in range(0, greatest(length(text), 1), 1000)] l from documents))
select doc_id || '::chunk_' || (row_number() over (order by doc_id, i) - 1) || '_' || substring(md5(chunk), 1, 8) chunk_id from p where chunk <> ''""",
        "bigram_vectors": f"""with b as (select conv_id, turn, substring(lower(text), unnest(range(1, length(text)))::int, 2) b from conversations),
c as (select conv_id, turn, (('0x' || substring(md5(b), 1, 8))::bigint % 64)::int bucket, count(*) n from b group by all)
select conv_id, turn, bucket, {six('n / sqrt(sum(n * n) over (partition by conv_id, turn)::double)')} weight from c""",
        "citations": """with a as (select conv_id, turn, 'see [' || (turn + 1) || '] and [' || conv_id % 5 || '] then [' || (turn + 1) || ']' t from conversations)
select conv_id, turn, case when turn + 1 = conv_id % 5 then (turn + 1)::varchar else (turn + 1) || ',' || conv_id % 5 end cites, (turn + 1 between 1 and 4) and (conv_id % 5 between 1 and 4) valid from a""",
        "sentences": "select doc_id, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?。！？；\\n])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> ''))::int n_sentences from documents",
    }
    return {k: v for k, v in found.items() if v}
