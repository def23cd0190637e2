"""Operators over document texts: splitting, filtering, keywords and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions import text as T
from caseloom.session import materialize

# Weight of a word pair; weights of a summary's first, last and short sentences, words of a short one, share of sentences.
PAIR_WEIGHT, FIRST, LAST, SHORT, SHORT_WORDS, SHARE = 1.6, 1.35, 1.1, 0.5, 5, 0.3
SENT = 200_000  # ids that are broadcast

def split_statements(docs: DataFrame, heading: str) -> DataFrame:
    """(doc_id, part, speaker, role, text): the text under each heading line, as one row.
    heading: a regular expression with two groups, speaker and role, that matches at a line's
    start. Text before the first heading is left out; without a heading there are no rows."""
    mark = "\u0001"
    marked = F.regexp_replace("text", rf"(?m)^{heading}$\n?", f"{mark}$1{mark}$2{mark}")
    parts = F.split(marked, mark)
    count = F.floor((F.size(parts) - 1) / 3).cast("int")
    rows = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(F.get(parts, 3 * k + 1).alias("speaker"), F.get(parts, 3 * k + 2).alias("role"), F.rtrim(F.regexp_replace(F.get(parts, 3 * k + 3), r"\n+$", "")).alias("text"))))
    return docs.select("doc_id", F.posexplode(rows).alias("part", "s")).select("doc_id", "part", "s.*")


def information_filter(docs: DataFrame, signal: str, boiler: str, least: int = 6000, sentence: int = 12, share: float = 0.25) -> DataFrame:
    """(doc_id, text, n_kept): of texts longer than `least`, only sentences with a signal and
    without boilerplate, each once; the whole text where that would leave under `share` of it.
    Sentences stay in one array per document: nothing shuffles."""
    all_ = T.sentences(F.col("text"), sentence)
    fit = F.filter(all_, lambda s: s.rlike(signal) & ~s.rlike(boiler))
    # The first of each by sorting: equal ones become neighbours, and the places bring the order back.
    keyed = F.sort_array(F.transform(fit, lambda s, i: F.struct(F.lower(s).alias("k"), i.alias("i"), s.alias("s"))))
    new = lambda xs: F.filter(xs, lambda x, j: (j == 0) | (F.get(xs, j - 1)["k"] != x["k"]))
    first = F.transform(F.sort_array(F.transform(T.let(keyed, new), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])
    kept = F.array_join(first, " ")
    use = (F.length("text") > least) & (F.length(kept) >= share * F.length("text"))
    return docs.select("doc_id", F.when(use, kept).otherwise(F.col("text")).alias("text"), F.when(use, F.size(first)).otherwise(-1).alias("n_kept"))


def keyword_frequency(docs: DataFrame, top: int = 8, pair_weight: float = PAIR_WEIGHT) -> DataFrame:
    """(doc_id, term, weight, rank): single words weigh 1 and word pairs pair_weight for each
    occurrence; totals of 2 or more, by weight and then term; a word that is part of a pair
    ranked before it is left out. Texts meet by doc_id, whole, and their terms are counted in the
    row: only totals of 2 or more become rows of their own."""
    texts = docs.groupBy("doc_id").agg(F.collect_list("text").alias("ts"))
    words = texts.select("doc_id", F.transform("ts", lambda t: T.tokens(t)).alias("ws"))
    weighed = lambda terms, weight: F.transform(T.counts(F.flatten(terms)), lambda c: F.struct(F.round(c["n"] * F.lit(weight), 6).alias("weight"), c["value"].alias("term")))
    enough = lambda cs: F.filter(cs, lambda c: c["weight"] >= 2)
    totals = F.concat(enough(weighed(F.col("ws"), 1.0)), enough(weighed(F.transform("ws", lambda ws: T.bigrams(ws)), pair_weight)))
    counted = words.select("doc_id", F.explode(totals).alias("c")).select("doc_id", "c.*")
    pair = F.col("term").contains(" ")
    parts = counted.select("doc_id", "weight", "term", pair.alias("pair"), F.posexplode(F.split("term", " ")).alias("k", "word"))
    before = F.coalesce(F.max("pair").over(Window.partitionBy("doc_id", "word").orderBy(F.desc("weight"), "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    kept = parts.withColumn("__before", before).where("k = 0 and (pair or not __before)")
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    return kept.select("doc_id", "term", "weight", F.row_number().over(w).alias("rank")).where(F.col("rank") <= top)


def summary_sentences(docs: DataFrame, ratio: float = SHARE) -> DataFrame:
    """(doc_id, pos, score, sentence): the ceil(n * ratio) best sentences of each document.
    score: the sum over a sentence's terms of df / largest df (sentences of the document that
    hold the term), over the root of its length in terms; 1.35 times for the first sentence,
    1.1 for the last, 0.5 for those under 5 words. Texts are scored in their rows; only ids are shuffled, to find those
    that several rows have: the sentences of these are added up across rows, where their terms meet."""
    in_rows = lambda rows: rows.select("doc_id", F.explode(best_sentences(T.sentences(F.col("text")), ratio)).alias("b")).select("doc_id", "b.*")
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    many = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("doc_id"), "repeated-ids")
    n = many.count()
    if not n:
        return in_rows(docs)
    several = F.broadcast(many) if n <= SENT else many
    return in_rows(docs.join(several, "doc_id", "left_anti")).unionByName(summary_of_rows(docs.join(several, "doc_id"), ratio))


def best_sentences(all_: Column, ratio: float) -> Column:
    """array<struct<pos, score, sentence>>: see summary_sentences. Terms are sorted, so that equal ones are neighbours, and then
    brought back into the order of the text: nothing is looked up, and work grows with the terms."""
    starts = lambda xs, f: F.filter(F.transform(xs, lambda _, i: i), lambda i: (i == 0) | (f(F.get(xs, i)) != f(F.get(xs, i - 1))))
    runs = lambda xs, f, g: T.let(starts(xs, f), lambda at: F.transform(at, lambda i, r: g(F.slice(xs, i + 1, F.coalesce(F.get(at, r + 1), F.size(xs)) - i), r)))

    def weighed(terms: Column) -> Column:
        """array<struct<pos, k, w>> in the order of the text."""
        placed = F.sort_array(F.flatten(F.transform(terms, lambda ts, i: F.transform(ts, lambda t, k: F.struct(t.alias("t"), i.alias("pos"), k.alias("k"))))))
        df = T.counts(F.flatten(F.transform(terms, lambda ts: F.array_distinct(ts))))  # of the terms in the order of `placed`
        own = lambda xs, ns, top: runs(xs, lambda x: x["t"], lambda run, r: F.transform(run, lambda x: F.struct(x["pos"].alias("pos"), x["k"].alias("k"), (F.get(ns, r)["n"] / top).alias("w"))))
        return F.sort_array(F.flatten(T.let(placed, lambda xs: T.let(df, lambda ns: T.let(F.array_max(F.transform(ns, lambda c: c["n"])), lambda top: own(xs, ns, top))))))

    def scored(xs: Column) -> Column:
        """Sentences with their terms, the best first."""
        # added in the sentence's order: sums of doubles in any other may fall on the other side of a half
        total = lambda run: F.aggregate(run, F.lit(0.0), lambda a, x: a + x["w"]) / F.sqrt(F.size(run))
        return T.let(xs, lambda ws: runs(ws, lambda x: x["pos"], lambda run, _: F.struct(F.get(run, 0)["pos"].alias("pos"), total(run).alias("total"))))

    def chosen(ss: Column) -> Column:
        n = F.size(ss)
        score = lambda x: F.round(x["total"] * position_factor(x["pos"], n, F.get(ss, x["pos"])), 6)
        ranked = F.sort_array(F.transform(scored(weighed(F.transform(ss, lambda s: T.tokens(s)))), lambda x: F.struct((-score(x)).alias("down"), x["pos"].alias("pos"))))
        return F.transform(F.slice(ranked, 1, F.ceil(n * F.lit(ratio)).cast("int")), lambda x: F.struct(x["pos"].alias("pos"), (-x["down"]).alias("score"), F.get(ss, x["pos"]).alias("sentence")))

    return T.let(all_, chosen)


def position_factor(pos: Column, n: Column, sentence: Column) -> Column:
    return F.when(pos == 0, FIRST).when(pos == n - 1, LAST).otherwise(1.0) * F.when(F.size(T.words(sentence)) < SHORT_WORDS, SHORT).otherwise(1.0)


def summary_of_rows(docs: DataFrame, ratio: float) -> DataFrame:
    """summary_sentences of documents of several rows: sentences of one place have the sum of their terms."""
    s = docs.select("doc_id", T.sentences(F.col("text")).alias("all")).select("doc_id", F.size("all").alias("n"), F.posexplode("all").alias("pos", "sentence"))
    s = s.withColumn("terms", T.tokens(F.col("sentence")))
    df = s.select("doc_id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("df"))
    top = F.max("df").over(Window.partitionBy("doc_id"))
    weight = df.select("doc_id", "term", (F.col("df") / top).alias("w"))
    terms = s.select("doc_id", "pos", F.posexplode("terms").alias("k", "term")).join(weight, ["doc_id", "term"])
    summed = terms.groupBy("doc_id", "pos").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("k", "w"))), F.lit(0.0), lambda a, x: a + x["w"]).alias("sum"))
    factor = position_factor(F.col("pos"), F.col("n"), F.col("sentence"))
    scored = s.join(summed, ["doc_id", "pos"]).withColumn("score", F.round(F.col("sum") / F.sqrt(F.size("terms")) * factor, 6))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    return scored.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= F.ceil(F.col("n") * ratio)).select("doc_id", "pos", "score", "sentence")


def carry_down(rows: DataFrame, group: str, order: list[str], header: Column, number: Column) -> DataFrame:
    """Adds `context`, the number of the last header at or before the row, and `in_order`,
    whether a header's number is above that of all headers before it."""
    w = Window.partitionBy(group).orderBy(*order)
    own = F.when(header, number)
    before = F.max(own).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"context": F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "in_order": F.when(header, before.isNull() | (number > before))})


def adjacent_runs(rows: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    """(group, run, key, n): adjacent rows of equal key as one entry, in order."""
    w = Window.partitionBy(group).orderBy(*order)
    new = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    runs = rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    return runs.groupBy(group, "run", key).agg(F.count(F.lit(1)).alias("n"))


def match_by_suffix(short: DataFrame, full: DataFrame, name: str = "name") -> DataFrame:
    """(short, full): a short name's one full name that ends with its last two folded words;
    none where several full names do."""
    tail = lambda c: F.array_join(F.slice(F.split(T.match_key(T.fold(F.col(c))), " "), -2, 2), " ")
    many = lambda c: F.size(F.split(T.match_key(T.fold(F.col(c))), " ")) >= 2
    a = short.where(many(name)).select(F.col(name).alias("short"), tail(name).alias("__t"))
    b = full.where(many(name)).select(F.col(name).alias("full"), tail(name).alias("__t")).distinct()
    one = b.groupBy("__t").agg(F.count(F.lit(1)).alias("__n"), F.min("full").alias("full")).where("__n = 1").select("__t", "full")
    return a.join(one, "__t").select("short", "full")


def stitch(a: Column, b: Column, least: int = 12, most: int = 200) -> Column:
    """a and b with their longest overlap (suffix of a, prefix of b) written once; a line
    break between them where there is none of at least `least` characters."""
    upto = F.least(F.length(a), F.length(b), F.lit(most))
    sizes = F.when(upto >= least, F.filter(F.sequence(F.lit(least), upto), lambda k: F.right(a, k) == F.left(b, k)))
    n = F.array_max(sizes)
    return F.when(n.isNotNull(), F.concat(a, F.substring(b, n + 1, F.length(b)))).otherwise(F.concat(a, F.lit("\n"), b))


def permissions(defaults: Column, overrides: Column) -> Column:
    """Sorted permissions: the role's defaults with the on/off overrides (map<string,boolean>)."""
    on = F.map_keys(F.map_filter(overrides, lambda _, v: v))
    off = F.map_keys(F.map_filter(overrides, lambda _, v: ~v))
    return F.array_sort(F.array_except(F.array_union(defaults, on), off))


def restore(existing: DataFrame, imported: DataFrame, key: str, valid: Column, version: Column | None = None) -> DataFrame:
    """Imported rows that are valid win over existing rows of the same key. Of several of one key the
    one of the largest version stays (nulls lowest; without a version, and among equal ones, the greatest row)."""
    good = imported.where(F.coalesce(valid, F.lit(False)))
    row = F.struct(*good.columns)
    rank = F.struct(row) if version is None else F.struct(version.isNotNull(), version, row)
    last = good.groupBy(key).agg(F.max_by(row, rank).alias("__row")).select("__row.*")
    return last.unionByName(existing.join(last.select(key), key, "left_anti").select(*last.columns))


def fill_empty(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with blank values of `columns` filled from other."""
    o = other.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    filled = {c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.col(f"__{c}")) for c in columns}
    return base.join(o, key, "left").withColumns(filled).select(*base.columns)
