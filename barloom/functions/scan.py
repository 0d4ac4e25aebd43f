"""Running values over histories of any length: blocks, a table of carries, then the blocks.

A window from a symbol's first row to the current one lies in one task. Here rows are
dealt by ranges of (symbol, time), so that a long history lies in many tasks, and
numbered; rows of one symbol with numbers in the same stretch of ``SIZE`` are a block.
Each running value is made in three steps, all of them Catalyst:

1. what each block adds, by a group-by on blocks;
2. what each block starts with: a running value over its symbol's blocks, some
   thousandth of the rows;
3. within each block, a window of at most ``SIZE`` rows that goes on from there.

Sums, counts, highest and lowest values, last known values and the row before are such
running values. So is an exponential mean: a step is the map e -> (1 - a) e + a x, maps
compose, and a block's map is (1 - a)^n e + c.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.shared import cut_lineage, parts

SIZE = 4096
#: Powers of 1 - a within a block stay above e to minus this.
STEEP = 450.0
AT = "__at"


def placed(df: DataFrame, *keys: str, order: str = "bar_ts") -> DataFrame:
    """Adds ``__at``, a number that grows along each key's history; rows are dealt by ranges and written once.

    A frame that has it, made from one that was placed by some of the keys, stays as it is.
    """
    if AT in df.columns:
        return df
    dealt = df.repartitionByRange(parts(df.sparkSession), *keys, order).sortWithinPartitions(*keys, order)
    return cut_lineage(dealt.withColumn(AT, F.monotonically_increasing_id()))


def block(size: int) -> Column:
    """First number of the block that a row lies in; numbers run from 0 in each range."""
    return F.col(AT) - F.pmod(F.col(AT).bitwiseAND((1 << 33) - 1), F.lit(size))


@dataclass(frozen=True)
class Running:
    """A running value of a column: kind is sum, count, max, min, last (the last that isn't null) or before (the row before)."""

    kind: str
    value: Column | str
    #: Whether the current row counts.
    now: bool = True


def _in_block(r: Running, frame: W, rows: W) -> Column:
    x = r.value if isinstance(r.value, Column) else F.col(r.value)
    if r.kind == "before":
        return F.lag(x).over(rows)
    made = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}.get(r.kind, lambda c: F.last(c, ignorenulls=True))
    return made(x).over(frame)


def _of_block(r: Running) -> Column:
    x = r.value if isinstance(r.value, Column) else F.col(r.value)
    if r.kind == "last":
        return F.max_by(x, F.when(x.isNotNull(), F.col(AT)))
    if r.kind == "before":
        return F.max_by(x, AT)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[r.kind](x)


def _carried(r: Running, name: str, earlier: W, blocks: W) -> Column:
    """What a block starts with, from what the blocks before it hold."""
    x = F.col(name)
    if r.kind == "before":
        return F.lag(x).over(blocks)
    if r.kind == "last":
        return F.last(x, ignorenulls=True).over(earlier)
    return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[r.kind](x).over(earlier)


def _joined(r: Running, inside: str, carry: str, first: Column) -> Column:
    a, b = F.col(carry), F.col(inside)
    if r.kind == "before":
        return F.when(first, a).otherwise(b)
    if r.kind == "last":
        return F.coalesce(b, a)
    if r.kind in ("sum", "count"):
        return F.coalesce(a + b, a, b)
    return (F.greatest if r.kind == "max" else F.least)(a, b)


def running(df: DataFrame, keys: tuple[str, ...], **wanted: Running) -> DataFrame:
    """Adds running values by key to a frame made by :func:`placed`; a value without a row that counts is null (a count is 0)."""
    g = [*keys, "__block"]
    rows = W.partitionBy(*g).orderBy(AT)
    frames = {True: rows.rowsBetween(W.unboundedPreceding, 0), False: rows.rowsBetween(W.unboundedPreceding, -1)}
    held = df.withColumn("__block", block(SIZE))
    sums = held.groupBy(*g).agg(*[_of_block(r).alias(f"__c_{n}") for n, r in wanted.items()])
    blocks = W.partitionBy(*keys).orderBy("__block")
    earlier = blocks.rowsBetween(W.unboundedPreceding, -1)
    carries = sums.select(*g, *[_carried(r, f"__c_{n}", earlier, blocks).alias(f"__c_{n}") for n, r in wanted.items()])
    inside = held.withColumns({f"__i_{n}": _in_block(r, frames[r.now], rows) for n, r in wanted.items()} | {"__first": F.row_number().over(rows) == 1})
    both = inside.join(carries, g, "left")
    made = {n: _joined(r, f"__i_{n}", f"__c_{n}", F.col("__first")) for n, r in wanted.items()}
    made = {n: F.coalesce(c, F.lit(0).cast("bigint")) if wanted[n].kind == "count" else c for n, c in made.items()}
    return both.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def exponential(df: DataFrame, keys: tuple[str, ...], adjust: bool = False, **wanted: tuple[Column | str, float]) -> DataFrame:
    """Adds exponential means, name=(column, a): e_t = (1 - a) e_(t-1) + a x_t from the first x that isn't null.

    A null x leaves the mean as it is; before the first x it is null. With ``adjust`` the
    weights (1 - a)^k of all values so far are made to add up to one instead.
    """
    keep = {n: max(1.0 - a, 1e-18) for n, (_, a) in wanted.items()}
    size = max(1, min(SIZE, *(int(STEEP / -math.log(q)) if q < 1.0 else SIZE for q in keep.values())))
    g = [*keys, "__block"]
    frame = W.partitionBy(*g).orderBy(AT).rowsBetween(W.unboundedPreceding, 0)
    value = {n: x if isinstance(x, Column) else F.col(x) for n, (x, _) in wanted.items()}
    held = df.withColumns({"__block": block(size)} | {f"__x_{n}": x.cast("double") for n, x in value.items()})
    # Values so far in the block, and the sum of what they differ from the block's first one, weighted so
    # that a later factor q^n makes it a mean. So the mean of equal values is exactly that value.
    held = held.withColumns({f"__n_{n}": F.count(f"__x_{n}").over(frame) for n in wanted} | {f"__f_{n}": F.lit(0.0) if adjust else F.first(f"__x_{n}", ignorenulls=True).over(frame) for n in wanted})
    weight = {n: 1.0 if adjust else wanted[n][1] for n in wanted}
    grown = {n: (F.col(f"__x_{n}") - F.col(f"__f_{n}")) * F.lit(weight[n]) * F.pow(F.lit(keep[n]), -F.col(f"__n_{n}")) for n in wanted}
    held = held.withColumns({f"__s_{n}": F.sum(grown[n]).over(frame) for n in wanted})

    of_block = []
    for n in wanted:
        count = F.max(f"__n_{n}")
        of_block.append(F.struct(F.col("__block").alias("b"), count.alias("n"), F.coalesce(F.max_by(f"__s_{n}", AT), F.lit(0.0)).alias("s"), F.max_by(f"__f_{n}", AT).alias("f")).alias(n))
    sums = held.groupBy(*g).agg(*of_block)
    lists = sums.groupBy(*keys).agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in wanted])
    starts = lists.select(*keys, F.explode(F.arrays_zip(*[_starts(F.col(n), keep[n], adjust).alias(n) for n in wanted])).alias("z"))
    first = next(iter(wanted))
    carries = starts.select(*keys, F.col(f"z.{first}.b").alias("__block"), *[F.col(f"z.{n}.e").alias(f"__e_{n}") for n in wanted], *[F.col(f"z.{n}.n").alias(f"__m_{n}") for n in wanted])
    both = held.join(carries, g, "left")
    made = {}
    for n in wanted:
        q, k = F.lit(keep[n]), F.col(f"__n_{n}")
        e = _after(F.coalesce(f"__e_{n}", F.lit(0.0)), keep[n], k, F.coalesce(f"__s_{n}", F.lit(0.0)), F.coalesce(f"__f_{n}", F.lit(0.0)))
        if adjust:
            e = e * (1.0 - q) / (1.0 - F.pow(q, k + F.coalesce(f"__m_{n}", F.lit(0))))
        made[n] = F.when(k + F.coalesce(f"__m_{n}", F.lit(0)) > 0, e)
    return both.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])


#: Blocks are carried on in stretches of so many, so that lists grow by small steps.
STRETCH = 256


def _after(e: Column, q: float, n: Column, s: Column, f: Column) -> Column:
    """The mean after n values of a block that began at e: f is the block's first value, s the weighted sum of differences from it."""
    return f + F.pow(F.lit(q), n) * ((e - f) + s)


def _starts(blocks: Column, q: float, adjust: bool) -> Column:
    """For each of a symbol's blocks (b, n, s, f) in order the mean e that it starts with and how many values precede it.

    The first mean is the first value (0 with ``adjust``), so that the map holds for it too.
    """
    after = lambda e, b: _after(e, q, b["n"], b["s"], F.coalesce(b["f"], F.lit(0.0)))
    one = lambda e, n: F.struct(e.alias("e"), n.alias("n"))
    whole = F.lit(0.0) if adjust else F.coalesce(F.get(F.filter(blocks, lambda b: b["f"].isNotNull()), F.lit(0))["f"], F.lit(0.0))
    stretches = F.transform(F.sequence(F.lit(0), F.size(blocks) - 1, F.lit(STRETCH)), lambda i: F.slice(blocks, i + 1, F.lit(STRETCH)))
    through = lambda begin, part: F.aggregate(part, begin, lambda s, b: one(after(s["e"], b), s["n"] + b["n"]))
    zero = one(whole, F.lit(0).cast("bigint"))
    heads = F.aggregate(stretches, F.array(zero), lambda s, part: F.concat(s, F.array(through(F.element_at(s, -1), part))))

    def inside(part: Column, i: Column) -> Column:
        begin = F.struct(F.get(heads, i).alias("now"), F.array().cast("array<struct<b:bigint,e:double,n:bigint>>").alias("out"))

        def step(s: Column, b: Column) -> Column:
            now = s["now"]
            entry = F.struct(b["b"].alias("b"), now["e"].alias("e"), now["n"].alias("n"))
            return F.struct(one(after(now["e"], b), now["n"] + b["n"]).alias("now"), F.concat(s["out"], F.array(entry)).alias("out"))

        return F.aggregate(part, begin, step, lambda s: s["out"])

    return F.flatten(F.transform(stretches, inside))
