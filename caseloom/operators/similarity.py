"""Set-similarity joins by prefix and length filters, and what questions they track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions import text as T
from caseloom.session import dealt, materialize

# Least similarity of a question and an asked line, of one issue and of two; an answer as
# short as this that hedges is vague.
SAME_ISSUE, OTHER_ISSUE, SHORT_ANSWER = 0.55, 0.70, 160
SENT = 200_000  # rows of a side that is broadcast
BLOCK = 1024  # ids of one text that are handled at once, or so


def word_set(text: Column) -> Column:
    """Distinct words of two characters or more of the match key."""
    return F.array_distinct(F.filter(F.split(T.match_key(text), " "), lambda w: F.length(w) > 1))


def ordered(sets: DataFrame, df: DataFrame) -> DataFrame:
    """sets (id, w): (id, size, w): the words that df has, rarest first. Of each set, words that df lacks
    count in its size only: no set of the other side holds them."""
    words = sets.select("id", F.size("w").alias("size"), F.explode("w").alias("word")).join(df, "word")
    return words.groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("o")).select("id", "size", F.transform("o", lambda x: x["word"]).alias("w"))


def prefix(sets: DataFrame, least: float) -> DataFrame:
    """The words of which two sets with a Jaccard of `least` or more share one at least, beside all of w. Words that df
    lacks stand first in the order and fill places of the prefix; a set that has no others there goes."""
    n = F.col("size") - F.ceil(F.col("size") * least - 1e-9).cast("int") + 1 - (F.col("size") - F.size("w"))
    return sets.where(n > 0).select("id", "size", "w", F.explode(F.slice("w", 1, n)).alias("word"))


def similar_sets(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a_id, b_id, score): pairs of sets (id, w; words that differ) with a Jaccard of at least `least`. Words that most
    sets hold stand last in their order, so they are in a prefix only where nothing rarer is, and a word
    that all sets hold makes no pairs. Sets of too different a size are not paired; the rest is verified on whole
    sets where it meets, so only pairs that are near leave the join. Empty sets are in no pair. Of b, only words
    that a has are dealt; a is sent to b's tasks where it has at most SENT rows."""
    word = lambda x: x.select(F.explode("w").alias("word"))
    own = word(a).groupBy("word").agg(F.count(F.lit(1)).alias("__n"))
    df = materialize(own.join(word(b).groupBy("word").agg(F.count(F.lit(1)).alias("__m")), "word").select("word", (F.col("__n") + F.col("__m")).alias("n")), "similar-words")
    ours = materialize(prefix(ordered(a, df), least), "similar-prefixes")
    l, r = (F.broadcast(ours) if ours.count() <= SENT else ours).alias("l"), prefix(ordered(b, df), least).alias("r")  # noqa: E741
    sizes = (F.col("l.size") >= least * F.col("r.size") - 1e-9) & (F.col("r.size") >= least * F.col("l.size") - 1e-9)
    shared = F.size(F.array_intersect("l.w", "r.w"))
    score = shared / (F.col("l.size") + F.col("r.size") - shared)
    met = r.join(l, (F.col("l.word") == F.col("r.word")) & sizes & (score >= least))
    return met.select(F.col("l.id").alias("a_id"), F.col("r.id").alias("b_id"), score.alias("score")).distinct()


def matched_texts(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a_key, b_key, score) of the distinct match keys (column `key`) of both: 1 where they are equal.
    Keys stand for themselves by 128-bit digests until pairs are found."""
    one = lambda x: x.where("key <> ''").select("key").distinct().select("key", F.unhex(F.md5("key")).alias("id"), F.array_distinct(F.filter(F.split("key", " "), lambda w: F.length(w) > 1)).alias("w"))
    l, r = one(a), one(b)  # noqa: E741
    equal = l.select("key").join(r.select("key"), "key").select(F.col("key").alias("a_key"), F.col("key").alias("b_key"), F.lit(1.0).alias("score"))
    near = similar_sets(l.select("id", "w"), r.select("id", "w"), least).where("a_id <> b_id")
    named = lambda x, n: x.select(F.col("id").alias(f"{n}_id"), F.col("key").alias(f"{n}_key"))
    return equal.unionByName(near.join(named(l, "a"), "a_id").join(named(r, "b"), "b_id").select("a_key", "b_key", "score"))


def alike(rows: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(a, b, score): all pairs of rows (id, keys, f; f a folded text) with equal keys and a < b whose texts have an edit
    similarity of at least `least`. Rows of one text meet others in blocks of their ids, so the texts of two blocks are compared
    once for all of their pairs. Pairs of blocks that are near are dealt out before they become pairs of ids: there may be
    as many as the square of a text's rows, in tasks that hold two blocks at a time."""
    own = [*keys, "f"]
    counted = rows.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("__n"))
    parts = rows.join(counted, own).withColumn("block", F.pmod(F.xxhash64("id"), F.col("__n"))).groupBy(*own, "block").agg(F.collect_list("id").alias("ids"))
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    equal = x("f") == y("f")
    fit = F.least(F.length(x("f")), F.length(y("f"))) >= least * F.greatest(F.length(x("f")), F.length(y("f")))
    on = (x("f") < y("f")) & fit | equal & (x("block") <= y("block"))
    for k in keys:
        on = on & (x(k) == y(k))
    score = F.when(equal, F.lit(1.0)).otherwise(T.edit_similarity(x("f"), y("f")))
    met = parts.alias("x").join(parts.alias("y"), on).select(
        x("f").alias("f"), y("f").alias("g"), x("block").alias("m"), y("block").alias("n"), *[x(k).alias(k) for k in keys], x("ids").alias("xs"), y("ids").alias("ys"), score.alias("score")
    )
    near = dealt(met.where(F.col("score") >= least), rows, *keys, "f", "g", "m", "n")
    once = F.col("one") & (F.col("i") < F.col("j")) | ~F.col("one") & (F.col("i") != F.col("j"))  # a block beside itself has each pair twice
    pairs = near.select(((F.col("f") == F.col("g")) & (F.col("m") == F.col("n"))).alias("one"), F.explode("xs").alias("i"), "ys", "score")
    pairs = pairs.select("one", "i", F.explode("ys").alias("j"), "score").where(once)
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "score")


def answer_quality(answer: Column, vague: str) -> Column:
    """empty, vague (short, and matching the pattern) or ok."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    return F.when(a == "", "empty").when(a.rlike(vague) & (F.length(a) < SHORT_ANSWER), "vague").otherwise("ok")


def tracked(questions: DataFrame, lines: DataFrame, vague: str, manual: DataFrame | None = None) -> DataFrame:
    """questions: (question_id, issue, text); lines: (issue, text, answer); manual: (key, status). Per
    question: how many lines asked it, how many of them are answered, and its status: answered, unclear
    (vague answers only), asked, open, or what `manual` says of its match key.

    Lines and questions of equal text are compared once. A line asks a question if they are equal,
    similar by OTHER_ISSUE, or similar by SAME_ISSUE and of one issue."""
    q = questions.select("question_id", "issue", T.match_key(F.coalesce("text", F.lit(""))).alias("key"))
    n = lines.select("issue", T.match_key(F.coalesce("text", F.lit(""))).alias("key"), answer_quality(F.col("answer"), vague).alias("quality")).where("key <> ''")
    said = n.groupBy("key", "issue").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") != "empty").alias("answered"), F.count_if(F.col("quality") == "ok").alias("ok"))
    near = matched_texts(q, said, SAME_ISSUE)
    asked = q.alias("q").join(near.alias("m"), F.col("q.key") == F.col("m.a_key")).join(said.alias("s"), F.col("m.b_key") == F.col("s.key"))
    asked = asked.where((F.col("m.score") >= OTHER_ISSUE) | F.col("q.issue").eqNullSafe(F.col("s.issue")))
    hits = asked.groupBy("question_id").agg(F.sum("s.n").alias("asked"), F.sum("s.answered").alias("answered"), F.sum("s.ok").alias("ok"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    auto = F.when(zero("ok") > 0, "answered").when(zero("answered") > 0, "unclear").when(zero("asked") > 0, "asked").otherwise("open")
    out = q.join(hits, "question_id", "left")
    if manual is not None:
        out = out.join(manual.select("key", F.col("status").alias("__manual")), "key", "left")
        auto = F.coalesce("__manual", auto)
    return out.select("question_id", "issue", zero("asked").alias("asked"), zero("answered").alias("answered"), auto.alias("status"))
