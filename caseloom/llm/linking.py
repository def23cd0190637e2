"""Connected groups from candidate keys, without pairs of all members of a group.

Rows that share a key are candidates. `linked_groups` first verifies one pair per row: the
row and the least row that it shares a key with, its leader. That ties most of a group of
copies together in linear work. Every key that still holds rows of several groups then
gets a reference row, the row nearest to its leader, and each of its rows is compared with
that: linear work, too. What is left are rows that are not linked with the reference, nor
in its group. Such a row can be linked with another only if both share some of their
differences from the reference (`Rule` says how many), so pairs are looked for by shared
differences, rarest first (`by_shared_differences`). Near misses of one text, each changed in places of its
own, share none and make no pairs, however many there are. Everything stays in DataFrames:
the driver sees counts only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.session import discard, materialize, materialize_parts

#: Of two linked rows, the least size of the smaller for each unit of the larger.
LEAST_SIZE = 0.8
#: Rows up to which a stored side of a join is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: Differences that are handled at once, of whole references: what their steps shuffle is many times the input.
SLICE = 10_000_000
#: Entries (id, key) that are dealt out by key at once.
ENTRIES = 25_000_000


def sized(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast if stored, which is read back from disk, has at most `rows` rows of a few numbers."""
    return F.broadcast(stored) if stored.count() <= rows else stored


def half(hashes: Column) -> Column:
    """The upper 32 bits of an array of 64-bit hashes, in the same order. Hashes don't compress, so these take half the room."""
    return F.transform(hashes, lambda h: F.shiftright(h, 32).cast("int"))


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(id, component), stored: the least id reachable, for every id in links (a, b), by
    alternating large-star and small-star steps until nothing changes."""
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label
    )
    state = None
    while True:
        n, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == state or n == 0:
            break
        state = (n, total)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), label)
        discard(before)
    of_other = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    out = materialize(of_other.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), f"{label}-groups")
    discard(edges)
    return out


@dataclass(frozen=True)
class Rule:
    """What a link tells of two rows' differences from one reference row.

    least(d, n, nr, apart): fewest differences that a row (with d of them, of size n, the
    reference of size nr) shares with any row that it may be linked to; apart says that the
    row is not in the reference's group. One row of each pair looked for is apart.
    enough(x, y, shared): whether rows x and y (fields d, n) that share at most `shared`
    differences may be linked."""

    least: Callable[[Column, Column, Column, Column], Column]
    enough: Callable[[Callable[[str], Column], Callable[[str], Column], Column], Column]
    #: far(part, size): whether a row of `size` tokens is by size alone apart from a common part of
    #: `part` tokens. With it, differences gives two columns more: t, the tokens of id, and own, how
    #: many of diff are these; they come first.
    far: Callable[[Column, Column], Column] | None = None


SAMPLE, HEAVY_SHARE = 0.01, 1e-4


def heavy_keys(entries: DataFrame) -> tuple[DataFrame, float]:
    """Keys with over HEAVY_SHARE of the rows of a sample of entries (key, id), 1 / HEAVY_SHARE keys at most, stored, and about how many
    entries there are. The sample decides the way, not the result."""
    sample = entries.sample(SAMPLE, seed=1).groupBy("key").count()
    total = sample.agg(F.sum("count")).first()[0] or 0
    return materialize(sample.where(F.col("count") > max(100.0, HEAVY_SHARE * total)).select("key"), "heavy-keys"), total / SAMPLE


def shared_keys(entries: DataFrame, heavy: DataFrame) -> DataFrame:
    """Those of entries (key, id) whose key has two ids or more.

    Most keys have one row, so a sum for each key before the shuffle would not shrink them:
    rows are dealt by key once, and each key looks for a second id. Heavy keys are left out of that, as a task would
    get all their rows; they are counted with a sum before the shuffle."""
    own = Window.partitionBy("key")
    light = entries.join(F.broadcast(heavy), "key", "left_anti").select("key", "id", F.min("id").over(own).alias("__lo"), F.max("id").over(own).alias("__hi"))
    light = light.where("__lo < __hi").select("key", "id")
    most = entries.join(F.broadcast(heavy), "key").select("key", "id")
    several = most.groupBy("key").agg(F.min("id").alias("__lo"), F.max("id").alias("__hi")).where("__lo < __hi").select("key")
    return light.unionByName(most.join(F.broadcast(several), "key", "left_semi"))  # several: fewer than heavy


def candidates(entries: DataFrame, sizes: DataFrame, label: str) -> DataFrame:
    """(id, key), stored, of entries (key, id), stored or cheap to read again and again: rows that share a
    key here share one there and fit by size, up to the width of a band, and no key that one row
    has alone is left but for the bands. sizes: (id, n), n > 0; of two linked rows, the smaller
    has at least LEAST_SIZE of the larger. Keys don't meet, and nearly all of them go: they are dealt out ENTRIES at a time, so
    that the room for them doesn't grow with the input."""
    # rows that fit by size have bands that are one apart at most, so they share one of two keys
    band = F.floor(F.log("n") / math.log(1 / LEAST_SIZE + 1e-9))
    heavy, total = heavy_keys(entries)
    slices = max(1, math.ceil(total / ENTRIES))

    def parts() -> Iterator[DataFrame]:
        for k in range(slices):
            own = entries.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == k) if slices > 1 else entries
            banded = shared_keys(own, heavy).join(sizes, "id").select("id", F.explode(F.array(band, band + 1)).alias("__band"), "key")
            yield banded.select("id", F.xxhash64("key", "__band").alias("key"))

    banded = materialize_parts(parts(), f"{label}-banded")
    discard(heavy)
    return banded


def linked_groups(
    banded: DataFrame, verify: Callable[[DataFrame], DataFrame], differences: Callable[[DataFrame], DataFrame], rule: Rule, label: str
) -> tuple[DataFrame, DataFrame]:
    """banded: what `candidates` gives; it is discarded.
    verify: of pairs (a, b), those that are links, with a score that is higher for nearer pairs, stored.
    differences: of pairs (ref, id, open), all of them as (ref, id, n, nr, score, diff), stored: sizes of
    id and ref, the score (null if they aren't linked; wanted where open), and the tokens that
    only one of them has. Tokens are 32 bits of a hash (`half`): two that fall together in one can only propose a pair more.
    Gives (id, component) of linked ids, and the verified links, both stored. All other tables
    are discarded as soon as what is made of them is stored."""
    heads = banded.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("__last")).where("leader < __last").drop("__last")
    shared = materialize(banded.join(heads, "key"), f"{label}-shared")
    discard(banded)
    star = materialize(shared.where("id <> leader").groupBy(F.col("id").alias("b")).agg(F.min("leader").alias("a")).select("a", "b"), f"{label}-pairs")
    links = verify(star)
    found = components(links, label)

    tagged = shared.join(found, "id", "left").select("key", "id", "leader", F.coalesce("component", "id").alias("c"))
    mixed = tagged.groupBy("key").agg(F.min("c").alias("__lo"), F.max("c").alias("__hi")).where("__lo < __hi").select("key")
    both = links.select("a", "b", "score").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    hub = both.groupBy(F.col("a").alias("leader")).agg(F.max(F.struct("score", "b"))["b"].alias("hub"))
    group = tagged.join(mixed, "key", "left_semi").select("leader", "id").distinct().join(hub, "leader", "left")
    group = group.select(F.coalesce("hub", "leader").alias("ref"), "id").where("ref <> id").distinct()
    # what has been verified, or is in one group already, needs no score
    group = group.join(star.select(F.col("a").alias("ref"), F.col("b").alias("id"), F.lit(True).alias("tried")), ["ref", "id"], "left")
    group = group.join(found.withColumnRenamed("component", "c"), "id", "left").join(found.select(F.col("id").alias("ref"), F.col("component").alias("cr")), "ref", "left")
    group = group.select("ref", "id", (F.col("tried").isNull() & (F.coalesce("c", "id") != F.coalesce("cr", "ref"))).alias("open"))
    group = materialize(group, f"{label}-refs")
    discard(shared, star)
    if not group.take(1):
        return found, links

    diff = differences(group)
    new = diff.where("score is not null").select(F.least("ref", "id").alias("a"), F.greatest("ref", "id").alias("b"), "score")
    links, found = joined(links, new, label, found, group)
    pairs = by_shared_differences(diff, found, rule, label)
    if pairs.take(1):
        new = verify(pairs)
        links, found = joined(links, new, label, found, new)  # new is stored, too
    discard(pairs)
    return found, links


def joined(links: DataFrame, new: DataFrame, label: str, *consumed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links with new ones, and the groups of both; links and what was consumed are discarded."""
    both = materialize(links.unionByName(new.select(*links.columns)), f"{label}-links")
    discard(links, *consumed)
    return both, components(both, label)


def by_shared_differences(diff: DataFrame, found: DataFrame, rule: Rule, label: str) -> DataFrame:
    """Pairs (a, b), stored, of rows with one reference, of different groups, of which one isn't in the
    reference's group, that share enough differences from it to be linked. diff is discarded.

    References don't meet, so they are handled in slices of SLICE differences or so, one after another: the room that the
    steps take grows neither with the input nor with the rows of a line's references, but for those of a single one."""
    slices = math.ceil((diff.agg(F.sum(F.size("diff"))).first()[0] or 0) / SLICE)
    if slices <= 1:
        return pairs_of_slice(diff, found, rule, label)
    whole = materialize(diff.withColumn("slice", F.pmod(F.xxhash64("ref"), F.lit(slices)).cast("int")), f"{label}-slices", "slice")
    discard(diff)

    def parts() -> Iterator[DataFrame]:
        for k in range(slices):
            own = whole.where(F.col("slice") == k).drop("slice")
            own.stored_at = f"{whole.stored_at}/slice={k}"
            pairs = pairs_of_slice(own, found, rule, label)
            yield pairs
            discard(pairs)

    met = materialize_parts(parts(), f"{label}-met")
    discard(whole)
    pairs = materialize(met.distinct(), f"{label}-pairs")
    discard(met)
    return pairs


def pairs_of_slice(diff: DataFrame, found: DataFrame, rule: Rule, label: str) -> DataFrame:
    """by_shared_differences of all of diff at once.

    A reference is left out whole where no such pair can be. The differences are by far the most rows here: they move
    by the number of their row, which is ascending where they are made, so that it compresses, and no table that
    holds them is kept once the next is stored.

    A prefix filter: a row's differences are put in one order, rarest first, and a pair that
    shares t of them shares one within the first d - t + 1 of each. In a group of copies, each
    made from one text by changes of its own, rows share the commonest differences at most, so
    their prefixes don't meet."""
    ours, theirs = found.select("id", F.col("component").alias("c")), found.select(F.col("id").alias("ref"), F.col("component").alias("cr"))
    rows = diff.join(ours, "id", "left").join(theirs, "ref", "left").select(
        "ref", "id", "n", "nr", F.size("diff").alias("d"), F.coalesce("c", "id").alias("c"), (F.coalesce("c", "id") != F.coalesce("cr", "ref")).alias("apart"), "diff", *(["t", "own"] if rule.far else [])
    )
    meets = rows.groupBy("ref").agg(F.max("apart").alias("__any"), F.min("c").alias("__lo"), F.max("c").alias("__hi")).where("__any and __lo < __hi").select("ref")
    rows = rows.join(meets, "ref", "left_semi")
    if rule.far is None:
        rows = rows.withColumn("far", F.lit(False))
    else:
        whole = materialize(rows, f"{label}-rows")
        discard(diff)
        diff, rows = whole, by_common_part(whole, rule)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), f"{label}-frames")
    discard(diff)
    tokens = rows.select("ref", "row", "apart", F.explode("diff").alias("token"))
    of_use = tokens.groupBy("ref", "token").agg(F.count(F.lit(1)).alias("f"), F.max("apart").alias("__any")).where("f > 1 and __any").drop("__any")
    own = Window.partitionBy("row")
    placed = tokens.drop("apart").join(of_use, ["ref", "token"]).select(
        "row", "token", F.row_number().over(own.orderBy("f", "token")).alias("k"), F.count(F.lit(1)).over(own).alias("m")
    )
    # tokens that no pair shares come first in the order: they fill the first d - m places
    placed = placed.join(rows.select("row", "ref", "id", "n", "nr", "d", "c", "apart", "far"), "row").withColumn("pos", F.col("d") - F.col("m") + F.col("k"))
    placed = placed.where(F.col("pos") <= F.col("d") - rule.least(*map(F.col, ("d", "n", "nr", "apart"))) + 1).drop("row", "k", "m", "nr")
    placed = materialize(placed, f"{label}-prefixes")
    discard(rows)
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    most = 1 + F.least(x("d") - x("pos"), y("d") - y("pos"))

    def meeting(one: str, other: str) -> DataFrame:
        fit = (x("ref") == y("ref")) & (x("token") == y("token")) & (x("c") != y("c")) & (~y("apart") | y("far") | (x("id") < y("id"))) & rule.enough(x, y, most)
        met = placed.where(one).alias("x").join(placed.where(other).alias("y"), fit)
        return met.select(F.least(x("id"), y("id")).alias("a"), F.greatest(x("id"), y("id")).alias("b"))

    met = meeting("apart and not far", "true")
    if rule.far is not None:
        met = met.unionByName(meeting("apart and far", "not apart"))
    pairs = materialize(met.distinct(), f"{label}-pairs")
    discard(placed)
    return pairs


def by_common_part(rows: DataFrame, rule: Rule) -> DataFrame:
    """rows with `far`, and once more the far ones, by their differences from the common part.

    Rows that are built around one passage share all that their reference has beside it, which
    tells nothing of how near they are to each other. The reference with all changes that over
    half of the rows apart from it have (twice a row's mean at most) is their common part: rows
    far from that, too, meet each other only by their differences from it, under a reference of
    its own."""
    apart = rows.where("apart")
    many = apart.groupBy("ref").agg(F.count(F.lit(1)).alias("rows")).where("rows > 2")
    common = apart.select("ref", "own", F.posexplode("diff").alias("pos", "token"))
    common = common.groupBy("ref", "token").agg(F.count(F.lit(1)).alias("f"), F.max(F.when(F.col("pos") < F.col("own"), 1).otherwise(-1)).alias("sign"))
    common = common.join(many, "ref").where("2 * f > rows").groupBy("ref").agg(F.collect_list("token").alias("common"), F.sum("sign").alias("more"))
    both = rows.join(common, "ref", "left").withColumn("__far_diff", F.concat(F.array_except("diff", "common"), F.array_except("common", "diff")))
    part = F.col("t") + F.col("d") - 2 * F.col("own") + F.col("more")  # tokens of the reference, and what the part has more
    both = both.withColumn("far", F.coalesce(F.col("apart") & rule.far(part, F.col("t")), F.lit(False)))
    framed = both.where("far").withColumns({"ref": F.xxhash64("ref", F.lit("common")), "diff": F.col("__far_diff"), "d": F.size("__far_diff"), "far": F.lit(False)})
    columns = ["ref", "id", "n", "nr", "d", "c", "apart", "far", "diff"]
    return both.select(*columns).unionByName(framed.select(*columns))
