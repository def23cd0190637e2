"""Range joins as equi-joins: a dyadic-interval index.

An interval of n whole numbers belongs to the least scale k with 2^k >= n and meets at most
two aligned bins of that scale. Each side is dealt to its own scale and to the larger scales that the
other side has, so two intervals that meet share a bin of the larger of their scales: the one
where they begin to meet, which finds each pair once. The join is on (columns, scale, bin)
and then tests the true bounds; no width is presumed, and there is no nested loop. A row is sent
once or twice for each scale of the other side, of which there are at most 63. Of two sides one of which
has FEW intervals, that one is sent and the other stays.

Null bounds are open. Dates, timestamps and numbers are binned by whole days, microseconds and units.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

TOP = 62  # scale of intervals without a bound
FEW = 10_000  # up to how many intervals go to the other side, which then stays where it is


def whole(c: Column, kind: str) -> Column:
    """A whole number in the order of c."""
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    return F.floor(c).cast("long")


def shifted(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k.cast("int"))


def placed(df: DataFrame, span: tuple[str, str]) -> DataFrame:
    """Adds __lo and __hi, whole and without nulls, and __k, the interval's scale; empty intervals go."""
    lo, hi = (whole(F.col(c), df.schema[c].dataType.simpleString()) for c in span)
    df = df.withColumns({"__lo": F.coalesce(lo, F.lit(-(1 << TOP))), "__hi": F.coalesce(hi, F.lit((1 << TOP) - 1))}).where("__lo <= __hi")
    open_ = F.col("__lo").eqNullSafe(-(1 << TOP)) & F.col("__hi").eqNullSafe((1 << TOP) - 1)
    size = F.col("__hi") - F.col("__lo")
    scale = F.when(open_ | (size < 0), TOP).when(size == 0, 0).otherwise(F.length(F.bin(size)))
    return df.withColumn("__k", F.least(scale, F.lit(TOP)).cast("int"))


def scales(df: DataFrame, span: tuple[str, str]) -> tuple[list[int], bool]:
    """The scales that occur, at most 63 numbers, and whether there are FEW rows. Points have scale 0 and aren't counted."""
    if span[0] == span[1]:
        return [0], False
    found = df.groupBy("__k").count().collect()
    return sorted(r[0] for r in found), sum(r[1] for r in found) <= FEW


def dealt(df: DataFrame, others: list[int]) -> DataFrame:
    """One row for each bin (__s, __b) of the own scale and of larger ones among others."""
    at = F.filter(F.array_distinct(F.concat(F.array("__k"), F.array(*map(F.lit, others)).cast("array<int>"))), lambda s: s >= F.col("__k"))
    bins = F.flatten(F.transform(at, lambda s: F.transform(F.sequence(shifted(F.col("__lo"), s), shifted(F.col("__hi"), s)), lambda b: F.struct(s.alias("s"), b.alias("b")))))
    return df.withColumn("__x", F.explode(bins)).select("*", F.col("__x.s").alias("__s"), F.col("__x.b").alias("__b")).drop("__x")


def overlapping(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], on: Sequence[str] = (), closed: bool = True, how: str = "inner") -> DataFrame:
    """Pairs of rows, equal in `on`, whose intervals meet: [start, end] if closed, else [start, end)
    (a span of one column twice is a point, which [start, end) holds from its start on). Columns of a, then
    those of b but `on`; apart from `on`, names must differ. how: inner or left_semi."""
    points = a_span[0] == a_span[1]
    ranked_a, ranked_b = placed(a, a_span), placed(b, b_span)
    (in_a, few_a), (in_b, few_b) = scales(ranked_a, a_span), scales(ranked_b, b_span)
    l, r = dealt(ranked_a, in_b), dealt(ranked_b, in_a)  # noqa: E741
    # Many rows in one wide bin of a few intervals would be one task's.
    if few_b:
        r = F.broadcast(r)
    elif few_a and how == "inner":
        l = F.broadcast(l)  # noqa: E741
    l, r = l.alias("l"), r.alias("r")  # noqa: E741
    col = lambda side, c: F.col(f"{side}.{c}")
    same = F.lit(True)
    for c in on:
        same &= col("l", c) == col("r", c)
    scale = F.greatest(col("l", "__k"), col("r", "__k"))
    start = F.greatest(col("l", "__lo"), col("r", "__lo"))
    same &= (col("l", "__s") == col("r", "__s")) & (col("l", "__b") == col("r", "__b"))
    same &= (col("l", "__s") == scale) & (col("l", "__b") == shifted(start, scale))
    (a0, a1), (b0, b1) = ((col("l", x) for x in a_span), (col("r", x) for x in b_span))
    before = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
    reached = b0 <= a1 if closed or points else b0 < a1
    true = (b0.isNull() | a1.isNull() | reached) & (a0.isNull() | b1.isNull() | before(a0, b1))
    out = l.join(r, same & true, how)
    keep = [col("l", c) for c in a.columns]
    if how == "inner":
        keep += [col("r", c) for c in b.columns if c not in on]
    return out.select(*keep)


def at_point(facts: DataFrame, rules: DataFrame, when: str, start: str, end: str, on: Sequence[str] = (), closed: bool = True) -> DataFrame:
    """Facts with the rules whose interval holds `when`; a null `when` meets none."""
    return overlapping(facts.where(F.col(when).isNotNull()), rules, (when, when), (start, end), on, closed)


def not_overlapping(a: DataFrame, b: DataFrame, span: tuple[str, str], on: Sequence[str] = (), closed: bool = True) -> DataFrame:
    """Rows of a whose interval meets none of b's (columns of the same names) with equal `on`."""
    other = b.select(*on, *[F.col(c).alias(f"__b{n}") for n, c in enumerate(span)])
    keys = [*on, *span]
    met = overlapping(a.select(*keys).distinct(), other, span, ("__b0", "__b1"), on, closed, "left_semi").distinct()
    met = met.select(*[F.col(c).alias(f"__m{n}") for n, c in enumerate(keys)])
    same = F.lit(True)
    for n, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"__m{n}"))
    return a.join(met, same, "left_anti")
