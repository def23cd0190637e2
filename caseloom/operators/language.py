"""n-gram statistics, phrase mining and spelling correction with a bigram model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from caseloom.functions import text as T
from caseloom.session import dealt, materialize

# Candidates of a word; the price of keeping an unknown word that has candidates, and of changing a known one in plain
# capitals; the smoothing of the model.
MOST, KEEP_UNKNOWN, CHANGE_CAPITALS, HALF, BACK_OFF, FLOOR = 12, 5.0, 1.2, 0.5, 3, 1e-9
# From how many occurrences in the lines on a form is broadcast instead of shuffled with its occurrences.
OFTEN = 100_000


def folded_words(text: Column) -> Column:
    return F.filter(F.split(T.fold(text), "[^a-z0-9]+"), lambda x: x != "")


def unigrams(docs: DataFrame, least: int = 3, longest: int = 7) -> DataFrame:
    """(word, n) of folded words of at most `longest` letters that occur `least` times or more."""
    w = F.filter(folded_words(F.col("text")), lambda x: F.length(x) <= longest)
    return docs.select(F.explode(w).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def counted_pairs(docs: DataFrame, words: Column, label: str) -> DataFrame:
    """(first, second, n), stored: neighbours in each text's words, which are computed once; the last word's second is null, so that
    a word's number of occurrences is that of the pairs it begins."""
    pairs = T.let(words, lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.struct(a.alias("first"), b.alias("second"))))
    return materialize(docs.select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count(F.lit(1)).alias("n")), label)


def bigram_model(docs: DataFrame, least: int = 3, longest: int = 7, least_pair: int = 2) -> DataFrame:
    """(first, second, n): adjacent folded words that occur least_pair times or more together, both among `unigrams`.
    The texts are cut into words once: a word's number of occurrences is that of the pairs it begins, and of the texts it
    ends, so one table of pairs, counted before it moves, gives both (the pair (word, null) ends a text)."""
    counted = counted_pairs(docs, folded_words(F.col("text")), "word-pairs")
    words = counted.groupBy("first").agg(F.sum("n").alias("__n")).where((F.col("__n") >= least) & (F.length("first") <= longest)).select("first")
    often = counted.where((F.col("n") >= least_pair) & F.col("second").isNotNull())
    return often.join(words, "first", "left_semi").join(words.withColumnRenamed("first", "second"), "second", "left_semi").select("first", "second", "n")


def phrase_weights(docs: DataFrame, most: int = 10) -> DataFrame:
    """(phrase, df, weight): folded word pairs by the number of documents that hold them;
    weight 3 for one document, 2 for two or three, 1 up to `most`; commoner ones are left out."""
    per_doc = docs.select("doc_id", F.explode(F.array_distinct(T.bigrams(T.tokens(F.col("text"))))).alias("phrase"))
    df = per_doc.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    return df.where(F.col("df") <= most).withColumn("weight", F.when(F.col("df") == 1, 3).when(F.col("df") <= 3, 2).otherwise(1))


def letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))


def spelling_model(docs: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """words (word, n) and pairs (first, second, n) of lower-case words with their marks; one pass over the texts."""
    counted = counted_pairs(docs, letters(F.lower(F.col("text"))), "spelling-pairs")
    words = counted.groupBy(F.col("first").alias("word")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return materialize(words, "spelling-words"), counted.where((F.col("n") >= least) & F.col("second").isNotNull())


@F.pandas_udf(ArrayType(StructType([StructField("k", IntegerType()), StructField("s", IntegerType())])))
def best_states(steps: pd.Series) -> pd.Series:
    """The states of the best path through each run of steps (k, a, b, v), sorted: v is what going from state a of place
    k - 1 to state b of place k adds. Scores and back pointers alone are kept; ties go to the state that comes first."""

    def of(rows) -> list[tuple[int, int]]:
        score, back, places = {}, [], []
        for k, a, b, v in ((r["k"], r["a"], r["b"], r["v"]) for r in rows):
            if not places or places[-1] != k:
                before = score if places else {}
                score, places = {}, [*places, k]
                back.append({})
            s = before.get(a, 0.0) + v
            if b not in score or s > score[b]:
                score[b] = s
                back[-1][b] = a
        at, out = max(score, key=lambda b: (score[b], -b)), []
        for k, pointers in zip(reversed(places), reversed(back), strict=True):
            out.append((k, at))
            at = pointers[at]
        return out[::-1]

    return pd.Series([of(rows) for rows in steps])


def corrected(lines: DataFrame, words: DataFrame, pairs: DataFrame, most: int = MOST) -> DataFrame:
    """(id, text, corrected, n_changed) of lines (id, text): the most probable words, by an interpolated bigram model, among those
    that are written alike without their marks.

    An unknown word of two letters or more may become any of the `most` commonest words of its skeleton, a known one in
    plain capitals too, at a price; a capitalised word after a capitalised one is a name and stays. Case is kept. A
    word that has no choice splits a line: only runs of words with choices, and the words beside them, leave the line, to meet
    the model in joins (words by skeleton, pairs of states by pair); the model is a table, in no task whole. It meets
    each form of a word once, not each occurrence; forms that occur OFTEN times are few and broadcast, so no word is hot.
    Null texts stay null."""
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tok = letters(F.col("text"))
    w = Window.partitionBy("id").orderBy("k")
    name = lambda ts: F.transform(ts, lambda x, i: F.struct(x.alias("tok"), (x.rlike(r"^\p{Lu}\p{Ll}+$") & F.coalesce(F.get(ts, i - 1).rlike(r"^\p{Lu}"), F.lit(False))).alias("__name")))
    t = lines.select("id", F.posexplode(T.let(tok, name)).alias("k", "x")).select("id", "k", "x.*", F.lower("x.tok").alias("w"))
    place = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("n"), "word"))
    index = words.select(T.fold(F.col("word")).alias("base"), "word", "n").withColumn("__p", place).where(F.col("__p") <= most)
    index = index.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("__p", "word", "n"))).alias("cands"))
    forms = t.groupBy("w").agg(F.count(F.lit(1)).alias("__n")).join(words.select(F.col("word").alias("w"), F.col("n").alias("u")), "w", "left")
    forms = materialize(forms.withColumn("base", T.fold(F.col("w"))).join(index, "base", "left").select("w", "__n", "u", "cands"), "spelling-forms")
    often, rest = forms.where(F.col("__n") >= OFTEN).drop("__n"), forms.where(F.col("__n") < OFTEN).drop("__n")
    t = t.join(F.broadcast(often), "w").unionByName(t.join(F.broadcast(often.select("w")), "w", "left_anti").join(rest, "w"))
    t = dealt(t, lines, "id")
    capitals = (F.upper("tok") == F.col("tok")) & (T.fold(F.col("tok")) == F.col("w"))
    may = (F.length("tok") > 1) & ~F.col("__name") & (F.col("u").isNull() | capitals)
    t = t.withColumn("cands", F.when(may, F.col("cands")))
    others = F.filter(F.coalesce("cands", F.array().cast("array<struct<__p: int, word: string, n: bigint>>")), lambda c: c["word"] != F.col("w"))
    price = F.when(F.col("u").isNull(), 0.0).otherwise(CHANGE_CAPITALS)
    state = lambda word, u, pen: F.struct(word.alias("w"), F.coalesce(u, F.lit(0)).cast("long").alias("u"), pen.cast("double").alias("pen"))
    own = state(F.col("w"), F.col("u"), F.when(F.col("u").isNull() & (F.size("cands") > 0), KEEP_UNKNOWN).otherwise(0.0))
    t = t.select("id", "k", F.concat(F.array(own), F.transform(others, lambda c: state(c["word"], c["n"], price))).alias("states"))
    free = F.size("states") > 1
    t = t.withColumns({"__free": free, "__near": free | F.coalesce(F.lag(free).over(w), F.lit(False)) | F.coalesce(F.lead(free).over(w), F.lit(False))})
    t = materialize(t.where("__near"), "spelling-states")
    # A run goes on while one of two neighbouring places is free; its first place is a forced word or the line's first.
    b = t.withColumns({"__pk": F.lag("k").over(w), "__ps": F.lag("states").over(w), "__pf": F.lag("__free").over(w)})
    joined = F.coalesce((F.col("__pk") == F.col("k") - 1) & (F.col("__free") | F.col("__pf")), F.lit(False))
    b = b.withColumns({"__on": joined, "run": F.sum(F.when(joined & (F.col("__pf") | F.lit(False)), 0).otherwise(1)).over(w)})
    first = F.array(F.struct(F.lit("").alias("w"), F.lit(0).cast("long").alias("u"), F.lit(0.0).alias("pen")))
    steps = b.where("__on or __free").select("id", "run", "k", F.posexplode(F.when(F.col("__on"), F.col("__ps")).otherwise(first)).alias("a", "x"), "states").select("id", "run", "k", "a", "x", F.posexplode("states").alias("b", "y"))
    seen = pairs.select(F.struct(F.col("first").alias("f"), F.col("second").alias("s")).alias("__p"), F.col("n").alias("__c"))
    steps = steps.withColumn("__p", F.struct(F.col("x.w").alias("f"), F.col("y.w").alias("s"))).join(seen, "__p", "left")
    uni = (F.col("y.u") + HALF) / F.lit(total + HALF * kinds)
    lam = F.col("x.u") / (F.col("x.u") + BACK_OFF)
    log = F.when(F.col("x.u") == 0, F.log(uni)).otherwise(F.log(lam * F.coalesce("__c", F.lit(0)) / F.col("x.u") + (1 - lam) * uni + FLOOR))
    steps = steps.select("id", "run", F.struct("k", "a", "b", (log - F.col("y.pen")).alias("v")).alias("s"))
    paths = steps.groupBy("id", "run").agg(F.sort_array(F.collect_list("s")).alias("ss")).select("id", F.explode(best_states("ss")).alias("c"))
    chosen = paths.select("id", F.col("c.k").alias("k"), F.col("c.s").alias("s")).where("s > 0").join(t.select("id", "k", "states"), ["id", "k"])
    news = chosen.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.get("states", F.col("s"))["w"]))).alias("__new"))

    def cased(sample: Column, word: Column) -> Column:
        return F.when((F.upper(sample) == sample) & (F.length(sample) > 1), F.upper(word)).when(sample.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 20))).otherwise(word)

    j = lines.join(news, "id", "left")
    new = F.transform(tok, lambda s, k: F.when(F.element_at("__new", k).isNotNull(), cased(s, F.element_at("__new", k))).otherwise(s))
    between = F.split("text", r"\p{L}+", -1)
    whole = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return j.select("id", "text", F.when(F.col("__new").isNull(), F.col("text")).otherwise(whole).alias("corrected"), F.coalesce(F.size("__new"), F.lit(0)).alias("n_changed"))
