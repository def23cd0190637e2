"""Money flows: edges between parties, their confirmation, edits, balances, gaps and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EDGE = ["src", "dst", "kind", "amount"]


def merge_edges(rows: DataFrame) -> DataFrame:
    """rows: (src, dst, kind, amount, at, said_by). Edges merged by (src, dst, kind, amount):
    how often, when first, and whether payer, receiver, both or others said so."""
    return rows.groupBy(*EDGE).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("at").alias("first_at"),
        F.coalesce(F.bool_or(F.col("said_by") == F.col("src")), F.lit(False)).alias("by_payer"),
        F.coalesce(F.bool_or(F.col("said_by") == F.col("dst")), F.lit(False)).alias("by_receiver"),
    ).withColumn("confirmed", confirmation(F.col("by_payer"), F.col("by_receiver")))


def confirmation(by_payer: Column, by_receiver: Column) -> Column:
    return F.when(by_payer & by_receiver, "both").when(by_payer, "payer").when(by_receiver, "receiver").otherwise("third")


def edited_edges(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Merged edges after an investigator's edits (src, dst, kind, amount, action): `reverse` turns the edge and
    who confirmed it, `drop` removes it, `kind:x` makes it one of kind x. An edge takes one edit,
    the last by name if there are several; edits of unknown edges and unknown actions change nothing."""
    last = edits.groupBy(*[F.col(c).alias(f"__{c}") for c in EDGE]).agg(F.max("action").alias("__action"))
    same = F.lit(True)
    for c in EDGE:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    j = edges.join(last, same, "left").where("__action is null or __action <> 'drop'")
    back = F.coalesce(F.col("__action") == "reverse", F.lit(False))
    kind = F.when(F.col("__action").startswith("kind:"), F.substring("__action", 6, 1 << 20)).otherwise(F.col("kind"))
    turned = {"src": F.when(back, F.col("dst")).otherwise(F.col("src")), "dst": F.when(back, F.col("src")).otherwise(F.col("dst")), "kind": kind}
    turned |= {"by_payer": F.when(back, F.col("by_receiver")).otherwise(F.col("by_payer")), "by_receiver": F.when(back, F.col("by_payer")).otherwise(F.col("by_receiver"))}
    return j.withColumns(turned).withColumn("confirmed", confirmation(F.col("by_payer"), F.col("by_receiver"))).select(*edges.columns)


def balances(edges: DataFrame, withdrawals: DataFrame | None = None) -> DataFrame:
    """Per party: in, out, withdrawn, flows of unknown amount, balance, and its part in the flow, which goes by
    whether it pays or receives at all, known amounts or not. withdrawals: (party, amount)."""
    amount = F.coalesce(F.col("amount"), F.lit(0))
    lost = F.col("amount").isNull().cast("int")
    zero = F.lit(0)
    side = lambda party, i, o, w, u, what: [F.col(party).alias("party"), i.alias("i"), o.alias("o"), w.alias("w"), u.alias("u"), F.lit(what).alias("what")]
    sides = edges.select(*side("src", zero, amount, zero, lost, "pays")).unionByName(edges.select(*side("dst", amount, zero, zero, lost, "gets")))
    if withdrawals is not None:
        sides = sides.unionByName(withdrawals.select(*side("party", zero, zero, amount, F.lit(0), "draws")))
    has = lambda what: F.bool_or(F.col("what") == what)
    out = sides.groupBy("party").agg(
        F.sum("i").alias("total_in"), F.sum("o").alias("total_out"), F.sum("w").alias("withdrawn"), F.sum("u").alias("unknown"),
        F.count_if(F.col("what") == "gets").alias("n_in"), F.count_if(F.col("what") == "pays").alias("n_out"), has("pays").alias("__pays"), has("gets").alias("__gets"), has("draws").alias("__draws"),
    )
    role = F.when(F.col("__pays") & F.col("__gets"), "middle").when(F.col("__pays") | F.col("__draws"), "source").otherwise("end")
    return out.withColumns({"balance": F.col("total_in") + F.col("withdrawn") - F.col("total_out"), "role": role}).drop("__pays", "__gets", "__draws")


def open_gaps(tolerance: float) -> Column:
    """array<struct<gap, amount>> of a row of `balances`, as `gaps` names them."""
    got = F.col("total_in") + F.col("withdrawn")
    pays, left = F.col("total_out") > 0, F.col("balance")
    unspent = F.when(pays & (left > tolerance) & (got > 0), left).when(~pays & (F.col("withdrawn") > tolerance), F.col("withdrawn"))
    gap = lambda name, amount: F.struct(F.lit(name).alias("gap"), amount.cast("double").alias("amount"))
    found = F.array(
        F.when(unspent.isNotNull(), gap("unspent", unspent)),
        F.when(pays & (left < -tolerance), gap("no source", -left)),
        F.when(F.col("unknown") > 0, gap("unknown", F.col("unknown"))),
    )
    return F.filter(found, lambda x: x.isNotNull())


def gaps(edges: DataFrame, withdrawals: DataFrame | None = None, tolerance: float = 0.0) -> DataFrame:
    """(party, gap, amount): what the flow leaves open. By known sums, whatever the party's role:
    unspent: known to have come in (received or withdrawn) and not seen to go out, of a party that pays out a known
    amount, or that withdrew and pays nothing; no source: more paid out than is known to have come in;
    unknown: how many flows of the party have no amount. If edges have `confirmed`, one row without a party
    counts those that not both sides confirm (one-sided)."""
    out = balances(edges, withdrawals).select("party", F.explode(open_gaps(tolerance)).alias("g")).select("party", "g.*")
    if "confirmed" in edges.columns:
        one = edges.agg(F.count_if(F.col("confirmed") != "both").cast("double").alias("amount")).where("amount > 0")
        out = out.unionByName(one.select(F.lit(None).cast(out.schema["party"].dataType).alias("party"), F.lit("one-sided").alias("gap"), "amount"))
    return out


def profiles(edges: DataFrame, withdrawals: DataFrame | None = None, most: int = 3) -> DataFrame:
    """Per party: its balance, its `most` largest counterparts (by flows, then name), the first day and its gaps. Counterparts
    are counted before they are ranked, so a party with many flows is one row per counterpart. The flows move once: sums
    of both sides are kept by (party, counterpart), and all that is said of a party comes from these rows."""
    from pyspark.sql import Window

    known, lost = F.coalesce(F.col("amount"), F.lit(0)), F.col("amount").isNull().cast("int")
    side = lambda party, other, what: F.struct(F.col(party).alias("party"), F.col(other).alias("other"), F.lit(what).alias("what"))
    both = edges.select(F.explode(F.array(side("src", "dst", "pays"), side("dst", "src", "gets"))).alias("s"), known.alias("a"), lost.alias("u"), "n", "first_at").select("s.*", "a", "u", "n", "first_at")
    of = lambda what, c: F.sum(F.when(F.col("what") == what, F.col(c)).otherwise(0))
    by = both.groupBy("party", "other").agg(
        of("gets", "a").alias("i"), of("pays", "a").alias("o"), F.sum("u").alias("u"), F.count_if(F.col("what") == "gets").alias("gets"),
        F.count_if(F.col("what") == "pays").alias("pays"), F.sum("n").alias("n"), F.min("first_at").alias("first_at"),
    )
    place = F.row_number().over(Window.partitionBy("party").orderBy(F.desc("n"), "other"))
    near = F.array_sort(F.collect_list(F.when(F.col("__k") <= most, F.struct("__k", "other"))))
    flow = by.withColumn("__k", place).groupBy("party").agg(
        *[F.sum(c).alias(c) for c in ("i", "o", "u", "gets", "pays")], F.count(F.lit(1)).alias("n_others"), F.min("first_at").alias("first_at"), near.alias("__o")
    )
    drawn = (withdrawals if withdrawals is not None else edges.select(F.col("src").alias("party"), "amount").where("false")).groupBy("party").agg(F.sum(F.coalesce("amount", F.lit(0))).alias("w"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    role = F.when((F.col("n_out") > 0) & (F.col("n_in") > 0), "middle").when((F.col("n_out") > 0) | F.col("w").isNotNull(), "source").otherwise("end")
    out = flow.withColumn("p", F.col("party")).join(drawn.withColumnRenamed("party", "q"), F.col("p").eqNullSafe(F.col("q")), "full")
    out = out.select(
        F.coalesce("p", "q").alias("party"), zero("i").alias("total_in"), zero("o").alias("total_out"), zero("w").alias("withdrawn"), zero("u").alias("unknown"),
        zero("gets").alias("n_in"), zero("pays").alias("n_out"), "w", "n_others", "first_at", "__o",
    )
    out = out.withColumns({"balance": F.col("total_in") + F.col("withdrawn") - F.col("total_out"), "role": role})
    # Nothing but its sums is said of a party without a name.
    own = lambda c, other=None: F.when(F.col("party").isNotNull(), c).otherwise(other)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(open_gaps(0.0), lambda g: g["gap"]))), ",")
    return out.select(
        "party", "role", "total_in", "total_out", "withdrawn", "balance", "n_in", "n_out", own(F.col("n_others")).alias("n_others"), own(F.col("first_at")).alias("first_at"),
        own(F.transform("__o", lambda x: x["other"])).alias("others"), own(names, F.lit("")).alias("gaps"),
    )
