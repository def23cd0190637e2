"""The most similar rows of a group, without pairs of all its rows.

Rows of one group score 1, 3 more for an equal kind and 2 more for amounts of which the smaller is
half of the larger at least; the best of each row are wanted, equal scores by id. The ids of one score
that come first are found from lists: the first ids of a (group, kind), of a group, and, where these hold too few
amounts that are near, of a range of amounts. For the ranges, amounts are dealt to powers of two: a row
is near all of its own, and near those beyond half (twice) its amount of the power below (above).
A sort by amount with the least ids so far gives the latter: a row is sent twice, however large the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.operators import relational as R
from caseloom.session import materialize

FIRST = 32  # ids of a list
UNITS = 1024.0  # to a whole: amounts below 1 / UNITS take the plain way


def near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 0.5 * F.greatest(a, b)


def score(x: Column, y: Column) -> Column:
    return 1 + (x["kind"] == y["kind"]).cast("int") * 3 + near(x["amount"], y["amount"]).cast("int") * 2


def power(amount: Column) -> Column:
    """Its power of two; 0 is its own, and amounts below are near none."""
    return F.when(amount == 0, -9).when(amount > 0, F.length(F.bin(F.floor(amount * UNITS).cast("long"))))


def listed(rows: DataFrame, on: list[str], most: int, name: str) -> DataFrame:
    """The first ids of each `on` with their rows, as an array."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*on).orderBy("id"))).where(F.col("__n") <= most)
    return first.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("id", "kind", "amount"))).alias(name))


def least_so_far(rows: DataFrame, window, value: str, most: int) -> DataFrame:
    """Adds __found, the `most` least values (nulls apart) at or before each row: of the value that comes and the least so far, the larger one
    goes on to the next place."""
    upto, before = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__v0", F.col(value))
    for k in range(most):
        v = F.col(f"__v{k}")
        rows = rows.withColumns({f"__m{k}": F.min(v).over(upto), "__p": F.min(v).over(before)})
        rows = rows.withColumn(f"__v{k + 1}", F.when(v.isNotNull() & F.col("__p").isNotNull(), F.greatest(v, F.col("__p"))))
    rows = rows.withColumn("__found", F.array_compact(F.array(*[f"__m{k}" for k in range(most)])))
    return rows.drop("__p", *[f"__v{k}" for k in range(most + 1)], *[f"__m{k}" for k in range(most)])


def first_near(asked: DataFrame, rows: DataFrame, on: list[str], most: int) -> DataFrame:
    """(x, y): rows asked and, of those of the same `on` whose amount is near, the first `most` ids of each power of two."""
    x, y = F.struct("id", "kind", "amount").alias("x"), F.struct("id", "kind", "amount").alias("y")
    powered = rows.select(*on, y, power(F.col("amount")).alias("e")).where("e is not null")
    q = asked.select(*on, x, power(F.col("amount")).alias("e")).where("e is not null")
    own = listed(rows.withColumn("e", power(F.col("amount"))), [*on, "e"], most + 1, "__found")
    within = q.join(own, [*on, "e"]).select("x", F.explode("__found").alias("y"))
    # side 1: the power below, from half the amount on; side -1: the power above, down from twice the amount
    sides = F.explode(F.array(F.lit(1), F.lit(-1))).alias("side")
    ask = q.select(*on, "x", "e", sides).select(*on, (F.col("e") - F.col("side")).alias("e"), "side", (F.col("side") * F.col("x.amount") * F.when(F.col("side") > 0, 0.5).otherwise(2.0)).alias("v"), "x")
    give = powered.select(*on, "y", "e", sides).join(ask.select(*on, "e", "side").distinct(), [*on, "e", "side"], "left_semi").withColumn("v", F.col("side") * F.col("y.amount"))
    both = give.unionByName(ask, allowMissingColumns=True)
    w = Window.partitionBy(*on, "e", "side").orderBy(F.desc("v"), F.col("x").isNotNull())  # amounts that are equal count
    beyond = least_so_far(both, w, "y", most).where("x is not null").select("x", F.explode("__found").alias("y"))
    return within.unionByName(beyond)


def most_similar(rows: DataFrame, most: int = 3, first: int = FIRST) -> DataFrame:
    """rows: (id, d, kind, amount). (a, b, score, rank): of each id, the `most` best of other ids of its d.

    Ids that occur twice and amounts that are no plain numbers (not finite, 2^52 or more, between 0 and 1 / UNITS) are compared
    with all of their group: such rows are few. Scores are null, and last, where a kind or an amount is."""
    rows = rows.where("id is not null and d is not null")
    amount = F.col("amount")
    strange = amount.isNotNull() & (F.isnan(amount) | (F.abs(amount) >= 2.0**52) | ((amount > 0) & (amount < 1 / UNITS)))
    rows = materialize(rows.withColumn("odd", strange | (F.count(F.lit(1)).over(Window.partitionBy("id")) > 1)), "similar-rows")
    odd, even = rows.where("odd").drop("odd"), rows.where("not odd").drop("odd")
    good, dim = even.where("kind is not null and amount is not null"), even.where("kind is null or amount is null")
    same, group = listed(good, ["d", "kind"], first, "__same"), listed(good, ["d"], first, "__group")
    x = even.join(same, ["d", "kind"], "left").join(group, "d", "left").join(listed(dim, ["d"], most + 1, "__dim"), "d", "left")
    x = x.join(odd.select("d", F.lit(True).alias("__met")).distinct(), "d", "left").withColumn("x", F.struct("id", "kind", "amount"))
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<struct<id:long,kind:string,amount:double>>"))
    other = lambda y: y["id"] != F.col("id")
    usual = F.col("kind").isNotNull() & amount.isNotNull()
    few, full = F.size(some("__same")) <= most, lambda c: F.size(some(c)) >= first
    # by the first near ones of its own kind most rows are told; lists are read further where these are too few
    x = x.withColumn("__near", F.slice(F.filter(some("__same"), lambda y: other(y) & near(amount, y["amount"])), 1, most))
    others = F.filter(some("__group"), lambda y: near(amount, y["amount"]) & (y["kind"] != F.col("kind")))
    short = F.size("__near") < most
    x = x.withColumns({
        "ask_kind": usual & short & full("__same"),
        "ask_group": usual & few & full("__group") & F.when(few, F.size(others) < most).otherwise(False),
    })
    scored = lambda y: F.struct(score(F.col("x"), y).isNull().alias("null"), (-score(F.col("x"), y)).alias("score"), y["id"].alias("b"))
    told = F.array_distinct(F.filter(F.concat(some("__same"), some("__group"), some("__dim")), other))
    best = F.when(~short, F.transform("__near", scored)).otherwise(F.slice(F.sort_array(F.transform(told, scored)), 1, most))
    settled = ~F.col("ask_kind") & ~F.col("ask_group") & F.col("__met").isNull()
    done = x.where(settled).select("id", F.posexplode(best).alias("k", "y")).select(F.col("id").alias("a"), "y.b", (-F.col("y.score")).alias("score"), (F.col("k") + 1).alias("rank"))

    open_ = materialize(x.where(~settled).select("d", "id", "kind", "amount", "ask_kind", "ask_group", best.alias("best")), "similar-open")
    known = open_.select(F.col("id").alias("a"), F.explode("best").alias("y")).select("a", "y.b", (-F.col("y.score")).alias("score"))
    sent = open_.drop("best")
    pairs = first_near(sent.where("ask_kind"), good, ["d", "kind"], most).unionByName(first_near(sent.where("ask_group"), good, ["d"], 2 * most))
    pairs = pairs.where("x.id <> y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), score(F.col("x"), F.col("y")).alias("score"))
    other_way = lambda one, two: one.select("d", F.struct("id", "kind", "amount").alias("x")).join(two.select("d", F.struct("id", "kind", "amount").alias("y")), "d").where("x.id <> y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), score(F.col("x"), F.col("y")).alias("score"))
    all_ = known.unionByName(pairs).distinct().unionByName(other_way(even, odd)).unionByName(other_way(odd, rows.drop("odd")))
    return done.unionByName(R.capped(all_, ["a"], [F.desc("score"), F.asc("b")], most).select(*done.columns))
