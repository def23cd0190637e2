"""Search by the beginnings of words, with snippets, over rows of several kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions import text as T

SPAN = 110  # fixed value: characters of a snippet


def query_words(query: str, spark) -> list[str]:
    """Folded words of a query, which may hold / . and -."""
    folded = spark.range(1).select(T.fold(F.lit(query)).alias("q")).first().q
    return re.sub(r"[^a-z0-9/.\- ]+", " ", folded).split()


def begins(folded: Column, word: str) -> Column:
    """Place, from 1, of the first word of the folded text that begins with `word`; 0 without one. A word that begins with a mark
    may stand anywhere."""
    before = r"(?<![a-z0-9])" if word[:1].isalnum() else ""
    return F.coalesce(F.regexp_instr(folded, F.lit(before + re.escape(word))), F.lit(0))


def snippet(text: Column, words: list[str], span: int = SPAN) -> Column:
    """About `span` characters around the first word of the query that the text has."""
    flat = F.regexp_replace(text, r"\s+", " ")
    folded = T.fold(flat)
    at = F.coalesce(*[F.nullif(begins(folded, w), F.lit(0)) for w in words], F.lit(0))
    start = F.greatest(F.lit(0), at - 1 - span // 3)
    part = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(flat, start + 1, F.lit(span)), F.when(start + span < F.char_length(flat), "…").otherwise(""))
    return F.when(at > 0, part).otherwise(F.concat(F.substring(flat, 1, span), F.when(F.char_length(flat) > span, "…").otherwise("")))


def search(rows: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """rows: (kind, id, title, text). Those of which title and text together have all words of the query, at the beginnings of words: (kind,
    id, in_title, snippet, rank, n), titles that have them all first, then by id; `limit` of each kind, and n, how many there are. An
    empty query finds nothing. One scan; only hits are ranked."""
    words = query_words(query, rows.sparkSession)
    if not words:
        return rows.select("kind", "id", F.lit(False).alias("in_title"), F.lit("").alias("snippet"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("n")).where("false")
    both = T.fold(F.concat_ws(" ", "title", "text"))
    has = lambda c: [begins(c, w) > 0 for w in words]
    every = lambda cs: F.coalesce(*[F.when(~c, F.lit(False)) for c in cs], F.lit(True))
    hits = rows.where(every(has(both))).select("kind", "id", every(has(T.fold(F.coalesce("title", F.lit(""))))).alias("in_title"), snippet(F.coalesce("text", F.lit("")), words).alias("snippet"))
    w = Window.partitionBy("kind").orderBy(F.desc("in_title"), "id")
    n = hits.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    top = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return top.join(n, "kind").select("kind", "id", "in_title", "snippet", "rank", "n")


# What a hit is worth by place (name, text, comment): all words, or the whole query; the most that further hits add.
WORTH = {"name": (80, 100), "text": (40, 50), "comment": (20, 30)}
MOST_HITS = 20


def search_book(outline: DataFrame, query: str, limit: int = 60) -> DataFrame:
    """Articles of outlined texts (see outline.outlined) that a query finds: (doc_id, article, place, score, hits, rank). A number finds the
    article of that number. Else an article's name and lines are graded: the whole query, or all its words at the beginnings of words; the best
    grade by place counts, and every line that is a hit adds one, up to MOST_HITS. place is the name if it is a hit, or the best line's."""
    spark = outline.sparkSession
    q = spark.range(1).select(F.trim(F.regexp_replace(T.fold(F.lit(query)), r"\s+", " ")).alias("q")).first().q
    own = outline.where("article is not null and kind in ('article', 'body', 'comment')")
    number = re.fullmatch(r"(?:dieu\s*)?(\d{1,3}[a-z]?)", q)
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "first")
    if number:
        found = own.where((F.col("kind") == "article") & (T.fold(F.col("article")) == number[1])).groupBy("doc_id", "article").agg(F.min("n").alias("first"))
        found = found.select("*", F.lit("name").alias("place"), F.lit(0).cast("long").alias("score"), F.lit(1).cast("long").alias("hits"))
    else:
        words = query_words(query, spark)
        if not words or len(q) < 2:
            return outline.select("doc_id", "article", F.lit("").alias("place"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("hits"), F.lit(0).alias("rank")).where("false")
        line = T.fold(F.when(F.col("kind") == "article", F.regexp_replace("line", r"^\s*Điều\s+\d{1,3}[a-zđ]?[.:]?\s+", "")).otherwise(F.col("line")))
        every = F.lit(True)
        for w in words:
            every &= begins(line, w) > 0
        whole = line.contains(q)
        place = F.when(F.col("kind") == "article", "name").when(F.col("kind") == "body", "text").otherwise("comment")
        worth = F.coalesce(*[F.when(place == p, F.when(whole, F.lit(full)).otherwise(F.lit(part))) for p, (part, full) in WORTH.items()])
        hits = own.where(whole | every).select("doc_id", "article", "n", place.alias("place"), worth.alias("worth"))
        lines = F.count_if(F.col("place") != "name")
        best = F.max_by("place", F.struct((F.col("place") == "name"), "worth", (-F.col("n")).alias("n")))
        found = hits.groupBy("doc_id", "article").agg(F.max("worth").alias("w"), lines.alias("lines"), best.alias("place"))
        first = own.groupBy("doc_id", "article").agg(F.min("n").alias("first"))
        found = found.join(first, ["doc_id", "article"]).select("doc_id", "article", "first", "place", (F.col("w") + F.least("lines", F.lit(MOST_HITS))).cast("long").alias("score"), F.greatest("lines", F.lit(1)).cast("long").alias("hits"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("doc_id", "article", "place", "score", "hits", "rank")


# What a catalogue entry is worth: its number, its name, one of its acts, its signs.
BY_NUMBER, BY_NAME, BY_ACT, BY_SIGNS = 100, 40, 20, 5


def search_catalogue(rows: DataFrame, query: str) -> DataFrame:
    """rows: (number, name, acts array<string>, signs array<string>, place). Those that a query finds, folded: (number, place, score): by its number
    (with or without the word for article), in the name, in one act, or in the signs taken together; the largest sum first, then by place.
    An empty query finds nothing. One scan; only hits are sorted, by range."""
    q = rows.sparkSession.range(1).select(F.btrim(F.regexp_replace(T.fold(F.lit(query)), r"\s+", " ")).alias("q")).first().q
    if not q:
        return rows.select("number", "place", F.lit(0).alias("score")).where("false")
    number = re.sub(r"^dieu\s*", "", q)
    holds = lambda c: F.coalesce(T.fold(c).contains(q), F.lit(False))
    act = F.coalesce(F.exists("acts", holds), F.lit(False))
    parts = ((F.col("number") == number, BY_NUMBER), (holds(F.col("name")), BY_NAME), (act, BY_ACT), (holds(F.array_join("signs", " ")), BY_SIGNS))
    score = sum((F.when(c, w).otherwise(0) for c, w in parts), F.lit(0))
    return rows.select("number", "place", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "place")


# What makes a candidate: cited, primary, shown by evidence, of a high level besides, named by a typical situation; how many are kept.
CITED, PRIMARY, EVIDENCE, LEVEL, SITUATION, CANDIDATES = 100, 90, 50, 10, 8, 8


def ranked_candidates(rows: DataFrame, group: str = "doc_id", limit: int = CANDIDATES) -> DataFrame:
    """rows: (group, article, cited, is_primary, shown, level, seeded, evidence). Per group the `limit` best articles: (group, article, score, rank). Repeated
    articles count with the best of each; nulls count as not; ties go by article."""
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    one = rows.groupBy(group, "article").agg(flag("cited").alias("c"), flag("is_primary").alias("p"), flag("shown").alias("s"), flag(F.col("shown") & (F.col("level") == "high")).alias("l"), flag("seeded").alias("t"), F.coalesce(F.max("evidence"), F.lit(0)).alias("e"))
    score = sum((F.when(F.col(c), w).otherwise(0) for c, w in (("c", CITED), ("p", PRIMARY), ("s", EVIDENCE), ("l", LEVEL), ("t", SITUATION))), F.col("e"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), "article")
    return one.select(group, "article", score.alias("score")).where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
