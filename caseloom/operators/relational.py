"""Joins, merges and windows that case data needs, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.operators import ranges, scans


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Latest row of each key; a change wins over an equal version of base. One aggregate, which
    combines before the shuffle."""
    both = base.withColumn("__src", F.lit(0)).unionByName(changes.withColumn("__src", F.lit(1)))
    latest = F.max_by(F.struct(*base.columns), F.struct(F.coalesce(F.col(version).isNotNull().cast("int"), F.lit(0)), F.col(version), F.col("__src")))
    return both.groupBy(key).agg(latest.alias("__row")).select("__row.*")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    keys = gone.select(parent_key).distinct()
    return parents.join(keys, parent_key, "left_anti"), children.join(keys.withColumnRenamed(parent_key, child_key), child_key, "left_anti")


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed rows; equal rows are left out."""
    j = old.select(key, F.col(value).alias("__o"), F.lit(1).alias("__a")).join(new.select(key, F.col(value).alias("__n"), F.lit(1).alias("__b")), key, "full")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__o").eqNullSafe(F.col("__n")), "changed")
    return j.select(key, change.alias("change")).where("change is not null")


def reconcile(rows: DataFrame, key: str, value: str, rank: Column) -> DataFrame:
    """(key, value, alternatives): the value of least rank (ties: least value), and how many others there are."""
    best = F.min(F.struct(rank.alias("r"), F.col(value).alias("v")))["v"]
    return rows.groupBy(key).agg(best.alias(value), (F.count_distinct(value) - 1).alias("alternatives"))


def valid_at(facts: DataFrame, rules: DataFrame, when: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rules whose [start, end] holds the fact's date; null bounds are open. An equi-join on dyadic bins."""
    return ranges.at_point(facts, rules, when, start, end)


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """left with the value of the last right row of the same key at or before its time: both
    sides are sorted once by key and time, and the value is carried forward."""
    a = left.withColumn("__t", F.col(left_time)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__s", F.lit(1))
    b = right.select(F.col(key), F.col(right_time).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__s"))
    w = Window.partitionBy(key).orderBy("__t", "__s").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(f"{value}_as_of", F.last("__v", True).over(w)).where("__s = 1").drop("__t", "__v", "__s")


def drop_adjacent_repeats(rows: DataFrame, group: list[str], order: list[str], value: Column) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumns({"__p": F.lag(value).over(w), "__k": F.row_number().over(w)}).where((F.col("__k") == 1) | ~F.col("__p").eqNullSafe(value)).drop("__p", "__k")


def non_overlapping(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Greedy choice of intervals by start (longest first): one pass over each group's sorted intervals, which
    remembers where the last one chosen ends."""
    def step(last, s, e):
        free = last is None or s >= last
        return (e if free else last), free

    spans = rows.select(group, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end))
    chosen = scans.scanned(spans, [group], [start, F.desc(end)], [start, end], "__free", "boolean", lambda: None, step)
    return chosen.where("__free").drop("__free")


def sliding_totals(events: DataFrame, key: str, time: str, value: Column, seconds: int, slice_seconds: int | None = None) -> DataFrame:
    """Totals over the last `seconds` seconds (the own row included), per key. Time is cut into slices (by default of 60 times
    `seconds`); a row within `seconds` of its slice's end is also sent to the next one, as what stands before it, so a key with a third of
    all rows is as many tasks as it has slices, and one row in sixty is sent twice."""
    width = (slice_seconds or 60 * seconds) * 1_000_000
    at, own = F.col("__at"), F.floor(F.col("__at") / width)
    near = (own + 1) * width - at < seconds * 1_000_000
    rows = events.withColumns({"__at": F.unix_micros(F.col(time).cast("timestamp")), "__v": value})
    copies = F.filter(F.array(F.struct(own.alias("s"), F.lit(True).alias("own")), F.when(near, F.struct((own + 1).alias("s"), F.lit(False).alias("own")))), lambda x: x.isNotNull())
    dealt = rows.withColumn("__x", F.explode(F.when(at.isNotNull(), copies).otherwise(F.array(F.struct(F.lit(None).cast("long").alias("s"), F.lit(True).alias("own"))))))
    w = Window.partitionBy(key, "__x.s").orderBy("__at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    totals = dealt.withColumns({"window_count": F.count(F.lit(1)).over(w), "window_total": F.sum("__v").over(w)})
    return totals.where("__x.own").drop("__at", "__v", "__x")


def session_numbers(events: DataFrame, key: str, time: str, tie: str, gap_seconds: int) -> DataFrame:
    """session_no, from 1, by gaps of more than gap_seconds."""
    w = Window.partitionBy(key).orderBy(time, tie)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    new = F.coalesce((at - F.lag(at).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    return events.withColumn("__new", new).withColumn("session_no", F.sum("__new").over(w)).drop("__new")


def capped(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each group, with their rank."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def budgeted(rows: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Greedy knapsack: of each group's rows, in the given order, those that still fit the budget (too large
    ones are passed over; a null size is none)."""
    def step(used, n):
        fits = used + (n or 0) <= budget
        return used + (n or 0) * fits, fits

    kept = scans.scanned(rows, [group], [*order, size], [size], "__fits", "boolean", lambda: 0, step)
    return kept.where("__fits").drop("__fits")


def status_pivot(rows: DataFrame, group: str, status: str, values: list[str]) -> DataFrame:
    """One column per status of a fixed list, zeros included, and the total."""
    return rows.groupBy(group).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values], F.count(F.lit(1)).alias("n_all"))
