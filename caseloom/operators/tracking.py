"""Tracked questions, statements, warnings, catalogues and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.operators import ranges

# What is shown at most, the share of the best score that words need, and how many of them are shown; an act's weights for
# pairs and words, the score of a whole phrase, the price of a missing qualifier, the least score, the least share of pairs.
SHOWN, NEAR_BEST, BY_WORDS = 5, 0.35, 2
PAIRS, WORDS, PHRASE, MISSING, LEAST_SCORE, LEAST_PAIRS = 0.75, 0.35, 0.7, 0.3, 0.34, 0.25


def ranked(value: Column, order: list[str]) -> Column:
    """Place of value in a fixed order, from 0; after the last for any other."""
    return F.coalesce(*[F.when(value == v, F.lit(k)) for k, v in enumerate(order)], F.lit(len(order)))


def owned_by(rows: DataFrame, owner: Column, account: str, secure: bool = False) -> DataFrame:
    """Rows of one account in one environment; the other environment's rows are never seen."""
    return rows.where(owner == f"{'s' if secure else 'u'}:{account}")


def items_of(plans: DataFrame, status: str | None = None) -> DataFrame:
    """plans: (plan, issues array<struct<issue, items array<struct<item, status>>>>). One row per item,
    of one status if it is named."""
    rows = plans.select("plan", F.explode("issues").alias("i")).select("plan", "i.issue", F.explode("i.items").alias("t")).select("plan", "issue", "t.item", "t.status")
    return rows.where(F.col("status") == status) if status else rows


def missing_fields(values: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """values: (key, field, value); rules: (kind, field, label) beside a `kind` of each key. One row
    per required field that is absent or blank."""
    wanted = values.select(key, "kind").distinct().join(rules, "kind")
    given = values.where(F.trim("value") != "").select(key, "field").distinct()
    return wanted.join(given, [key, "field"], "left_anti").select(key, "field", "label")


def range_bucket(n: Column, bounds: list[tuple[int, str]]) -> Column:
    """Name of the first bound (in rising order) that is at least n; null beyond the last."""
    return F.coalesce(*[F.when(n <= top, F.lit(name)) for top, name in bounds])


def records_of_plans(plans: DataFrame, records: DataFrame) -> DataFrame:
    """(plan_id, record_id): by the record's plan where it names one, else by case (null-safe),
    article and role: two equi-joins instead of a join on OR."""
    direct = records.where("plan_id is not null").join(plans.select("plan_id"), "plan_id").select("plan_id", "record_id")
    r, p = records.where("plan_id is null").drop("plan_id").alias("r"), plans.alias("p")
    on = F.col("r.case_id").eqNullSafe(F.col("p.case_id")) & (F.col("r.article") == F.col("p.article")) & (F.col("r.role") == F.col("p.role"))
    return direct.unionByName(r.join(p, on).select("p.plan_id", "r.record_id"))


def match_once(pending: DataFrame, given: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """(group, pending order, given order): each given row answers one pending row: first those of equal
    key, in order, then what is left over on both sides, in order."""
    by_key, in_order = Window.partitionBy(group, key).orderBy(order), Window.partitionBy(group).orderBy(order)
    p = pending.select(group, key, F.col(order).alias("p_at"), F.row_number().over(by_key).alias("__n"))
    g = given.select(group, key, F.col(order).alias("g_at"), F.row_number().over(by_key).alias("__n"))
    exact = p.join(g, [group, key, "__n"]).select(group, "p_at", "g_at")
    rest = lambda x, at: x.join(exact.select(group, at), [group, at], "left_anti").select(group, F.col(at).alias(order), F.row_number().over(Window.partitionBy(group).orderBy(at)).alias("__n"))
    left = rest(p, "p_at").withColumnRenamed(order, "p_at").join(rest(g, "g_at").withColumnRenamed(order, "g_at"), [group, "__n"]).select(group, "p_at", "g_at")
    return exact.unionByName(left)


def catalogue_with_library(catalogue: DataFrame, library: DataFrame, number: str, last: str) -> DataFrame:
    """catalogue with the library's row of the same number (upper case, no spaces, no leading zeros); of
    several, the last."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.upper(c), r"\s+", ""), r"^0+(?=\d)", "")
    own = [c for c in library.columns if c != number]
    latest = library.groupBy(norm(F.col(number)).alias("__k")).agg(F.max_by(F.struct(*own), F.col(last)).alias("__l"))
    return catalogue.withColumn("__k", norm(F.col(number))).join(latest, "__k", "left").drop("__k").withColumnRenamed("__l", "in_library")


def denials(statements: DataFrame) -> DataFrame:
    """statements: (case_id, line, speaker, kind, a, b, denies). Each denial, and whether another
    speaker claims the same thing of the same pair, named in either order."""
    pair = statements.withColumn("__p", F.array_sort(F.array("a", "b")))
    claims = pair.where("not denies").groupBy("case_id", "kind", "__p").agg(F.min("speaker").alias("__lo"), F.max("speaker").alias("__hi"))
    told = pair.where("denies").join(claims, ["case_id", "kind", "__p"], "left")
    other = (F.col("__lo") != F.col("speaker")) | (F.col("__hi") != F.col("speaker"))  # two bounds tell whether anyone else claims it
    return told.select("case_id", "line", "speaker", F.when(F.coalesce(other, F.lit(False)), "contradicted").otherwise("denied").alias("finding"))


def element_matrix(elements: DataFrame, support: DataFrame, confession: Column) -> DataFrame:
    """elements: (case_id, element); support: (case_id, element, source, kind). Per element: how many
    sources support it, and whether confessions alone do."""
    by = support.groupBy("case_id", "element").agg(F.count_distinct("source").alias("sources"), F.bool_and(confession).alias("__only"))
    out = elements.join(by, ["case_id", "element"], "left")
    return out.select("case_id", "element", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("__only", F.lit(False)).alias("confession_only"))


def with_overrides(defaults: DataFrame, saved: DataFrame, key: str, value: str) -> DataFrame:
    """defaults with saved values that are finite and above 0."""
    good = saved.where((F.col(value) > 0) & ~F.isnan(value)).select(key, F.col(value).alias("__v"))
    return defaults.join(good, key, "left").withColumn(value, F.coalesce("__v", value)).drop("__v")


def article_order(number: Column) -> Column:
    """217 < 217a < 218: ten times the number, and the letter's place."""
    letter = F.lower(F.regexp_extract(number, r"^\d+([a-zA-Z])", 1))
    return F.regexp_extract(number, r"^(\d+)", 1).cast("int") * 10 + F.when(letter != "", F.ascii(letter) - 96).otherwise(0)


def rebuilt_catalogue(curated: DataFrame, generated: DataFrame, official: DataFrame, hidden: DataFrame, key: str, text: str) -> DataFrame:
    """Curated rows and generated ones that no curated row covers; official texts replace both;
    hidden rows go."""
    rows = curated.select(key, text).unionByName(generated.select(key, text).join(curated.select(key), key, "left_anti"))
    rows = rows.join(official.select(key, F.col(text).alias("__t")), key, "left").withColumn(text, F.coalesce("__t", text)).drop("__t")
    return rows.join(hidden.select(key), key, "left_anti")


def without_overlaps(rows: DataFrame, others: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """rows whose [start, end) meets none of others' in the same group, whatever their lengths."""
    return ranges.not_overlapping(rows, others, (start, end), [group], closed=False)


def lockouts(events: DataFrame, key: str, order: list[str], failed: Column, cleared: Column, every: int = 5, minutes: int = 5, most: int = 1 << 40) -> DataFrame:
    """Of each key, the events that lock it: every fifth failure since the last success, for
    5, 10, 20, ... minutes, `most` at most (a whole number, long)."""
    w = Window.partitionBy(key).orderBy(*order)
    rounds = events.withColumn("__run", F.sum(cleared.cast("int")).over(w)).withColumn("__f", failed)
    own = Window.partitionBy(key, "__run").orderBy(*order)
    n = rounds.withColumn("__n", F.sum(F.col("__f").cast("int")).over(own))
    hit = n.where(F.col("__f") & (F.col("__n") % every == 0))
    doubled = F.pow(F.lit(2), F.least(F.col("__n") / every - 1, F.lit(62)))
    return hit.withColumn("minutes", F.least(F.lit(float(most)), minutes * doubled).cast("long")).drop("__run", "__f", "__n")


def shown(rows: DataFrame, group: str, most: int = SHOWN, ratio: float = NEAR_BEST, by_words: int = BY_WORDS) -> DataFrame:
    """rows: (group, name, family, source, score), source being pinned, recogniser or words. Pinned ones,
    then recognisers by score, then the best by words whose family isn't shown yet and whose score
    is near the group's best; at most `most`."""
    firm = rows.where("source <> 'words'")
    best = Window.partitionBy(group)
    words = rows.withColumn("__best", F.max("score").over(best)).where((F.col("source") == "words") & (F.col("score") >= ratio * F.col("__best")))
    words = words.join(firm.select(group, "family").distinct(), [group, "family"], "left_anti").drop("__best")
    words = words.withColumn("__w", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "name"))).where(F.col("__w") <= by_words).drop("__w")
    w = Window.partitionBy(group).orderBy(ranked(F.col("source"), ["pinned", "recogniser"]), F.desc("score"), "name")
    return firm.unionByName(words).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def act_match(act: Column, sentence: Column, phrase: Column, text: Column, missing: Column) -> Column:
    """Score of an act's terms in a sentence (arrays of words): shared pairs and words, at least 0.7 for the
    whole phrase, less 0.3 for a missing qualifier; null under 0.34."""
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    nb, nu = F.size(pairs(act)), F.size(F.array_distinct(act))
    b, u = F.size(F.array_intersect(pairs(act), pairs(sentence))), F.size(F.array_intersect(act, sentence))
    whole = (phrase != "") & text.contains(phrase)
    score = F.least(F.lit(1.0), b / F.greatest(F.lit(2), nb) * PAIRS + u / F.greatest(F.lit(3), nu) * WORDS)
    score = F.when(whole, F.greatest(score, F.lit(PHRASE))).when((b >= 2) & (b / nb >= LEAST_PAIRS), score)
    score = score - F.when(missing, MISSING).otherwise(0.0)
    return F.when(score >= LEAST_SCORE, score)
