"""Chunks, their ranking for queries, and the context made of the best."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from caseloom.functions import text as T
from caseloom.operators import recognisers
from caseloom.session import dealt, materialize

# Characters of a chunk, and from how many sizes on a paragraph is cut; what a whole query and
# a pair of its words add to a score; the least length of a query that counts as a whole; words of a chunk that weigh as its length.
SIZE, LONG, WHOLE, PAIR, LEAST_QUERY, WORDS = 900, 1.6, 6.0, 1.5, 7, 120
CONTEXT = 14_000


BOUNDS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("first", "n", "start")]))


@F.pandas_udf(BOUNDS)
def chunk_bounds(lengths: pd.Series, size: pd.Series) -> pd.Series:
    """Of each document's paragraph lengths: its chunks, as runs of paragraphs (first, n), or, for a piece
    of a long paragraph, where in it the piece starts (from 0; -1 for runs). One pass, by lengths alone."""

    def of(ns, most: int) -> list[tuple[int, int, int]]:
        out, first, held = [], 0, 0
        for k, n in enumerate(() if ns is None else ns):
            if held and held + n > most:
                out.append((first, k - first, -1))
                held = 0
            if n > LONG * most:
                out += [(k, 1, at) for at in range(0, n, most)]
            else:
                first = first if held else k
                held += n + bool(held)
        if held:
            out.append((first, len(ns) - first, -1))
        return out

    return pd.Series([of(ns, int(s)) for ns, s in zip(lengths, size, strict=True)])


def pack_chunks(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, chunk_no, chunk): trimmed paragraphs are gathered until the next would pass `size`
    characters; paragraphs of over LONG sizes are cut into pieces of `size`, each a chunk. The texts stay where they
    are: only lengths go to the one Python function, and a document without paragraphs has no chunks."""
    parts = F.filter(F.transform(F.split("text", r"\n+"), lambda p: F.btrim(p, F.lit(" \t\r\u000b\u000c "))), lambda p: p != "")
    cut = docs.select("doc_id", parts.alias("ps")).withColumn("bs", chunk_bounds(F.transform("ps", lambda p: F.char_length(p)), F.lit(size)))

    def text(b: Column) -> Column:
        run = F.array_join(F.slice(F.col("ps"), b["first"] + 1, b["n"]), "\n")
        return F.when(b["start"] < 0, run).otherwise(F.substring(F.get("ps", b["first"]), b["start"] + 1, F.lit(size)))

    return cut.select("doc_id", F.posexplode(F.transform("bs", text)).alias("chunk_no", "chunk"))


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(T.fold(text), r"\s+", " "))


def rank_chunks(docs: DataFrame, queries: DataFrame, limit: int = 8, size: int = SIZE) -> DataFrame:
    """(item_id, doc_id, chunk_no, score, rank): the best chunks of each query (item_id, text).

    score: over the query's terms the sum of (1 + ln tf) * ln(1 + N / df), df and N counting chunks; WHOLE more if the
    chunk holds the query as it is written, PAIR for each pair of terms that it holds side by side; all over the root of
    1 + terms / WORDS. Chunks that score nothing have no row; ties go by doc_id and chunk. Chunks are made and stored once;
    of their words only those of queries, which are broadcast, leave a task, and whole queries and pairs are found by
    one automaton. Postings are dealt out by chunk once: scores are added and the best of each query taken where they are,
    so the pairs of query and chunk, many times the postings, never move.

    A query without terms gets no rows (take the first chunks instead)."""
    low = pack_chunks(docs, size).select("doc_id", "chunk_no", T.fold(F.col("chunk")).alias("low"))
    chunks = materialize(low.withColumn("len", F.size(T.tokens(F.col("low")))), "chunks")
    q = queries.select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("ts"), flat(F.col("text")).alias("q")).where(F.size("ts") > 0)
    terms = q.select("item_id", F.explode("ts").alias("key"))
    tf = chunks.select("doc_id", "chunk_no", "len", F.explode(T.tokens(F.col("low"))).alias("key")).join(F.broadcast(terms.select("key").distinct()), "key", "left_semi")
    tf = tf.groupBy("doc_id", "chunk_no", "len", "key").agg(F.count(F.lit(1)).alias("tf"))
    pairs = F.transform(T.bigrams(F.col("ts")), lambda p: F.struct(p.alias("key"), F.lit(PAIR).alias("v")))
    whole = F.when(F.length("q") >= LEAST_QUERY, F.array(F.struct(F.col("q").alias("key"), F.lit(WHOLE).alias("v")))).otherwise(F.array().cast("array<struct<key: string, v: double>>"))
    wanted = q.select("item_id", F.explode(F.concat(pairs, whole)).alias("p")).select("item_id", "p.*")
    phrases = wanted.select(F.col("key").alias("phrase_id"), F.col("key").alias("phrase"), F.lit("find").alias("kind")).distinct()
    held = recognisers.phrase_hits(chunks, ["doc_id", "chunk_no", "len"], "low", phrases, limits=False).select("doc_id", "chunk_no", "len", F.col("phrase_id").alias("key")).distinct()
    postings = tf.select("doc_id", "chunk_no", "len", "key", F.lit(False).alias("phrase"), (1 + F.log("tf")).alias("m"))
    postings = materialize(postings.unionByName(held.withColumns({"phrase": F.lit(True), "m": F.lit(1.0)})), "chunk-postings")
    n = chunks.count()
    df = postings.where("not phrase").groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    worth = terms.join(df, "key").select("item_id", "key", F.lit(False).alias("phrase"), F.log(1 + F.lit(n) / F.col("df")).alias("v"))
    worth = materialize(worth.unionByName(wanted.select("item_id", "key", F.lit(True).alias("phrase"), "v")), "query-weights")
    met = dealt(postings, docs, "doc_id", "chunk_no").join(F.broadcast(worth), ["key", "phrase"])
    summed = met.groupBy("item_id", "doc_id", "chunk_no", "len").agg(F.sum(F.col("m") * F.col("v")).alias("s"))
    scored = summed.withColumn("score", F.round(F.col("s") / F.sqrt(1 + F.col("len") / WORDS), 6)).where("score > 0")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "chunk_no")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("item_id", "doc_id", "chunk_no", "score", "rank")


def context(hits: DataFrame, name: str = "name", most: int = CONTEXT) -> DataFrame:
    """(item_id, context, n_used) of hits (item_id, rank, name, chunk_no, chunk): numbered blocks, in order, as long as they
    fit `most` characters; one that doesn't is passed over. A query has as many hits as its search had a limit."""
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] ("), F.col(name), F.lit(" - "), F.col("chunk_no") + 1, F.lit(")\n"), F.col("chunk"), F.lit("\n\n"))
    listed = hits.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(F.length(a["out"]) + F.length(x["b"]) <= most, F.struct(F.concat(a["out"], x["b"]).alias("out"), (a["n"] + 1).alias("n"))).otherwise(a)
    return listed.select("item_id", F.aggregate("bs", start, step).alias("c")).select("item_id", F.rtrim(F.regexp_replace("c.out", r"\n+$", "")).alias("context"), F.col("c.n").alias("n_used"))


def tf_idf_rank(docs: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """(item_id, doc_id, score, rank): score is the sum over the query's terms of
    (1 + ln tf) * ln(1 + N / df), over sqrt(1 + terms). The postings of the queries' terms are stored once, for the
    document frequencies and the scores; words of no query, which are broadcast, never leave the scan. Postings are dealt out by
    document once, and scores are added there."""
    terms = queries.select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    wanted = terms.select("term").distinct()
    words = docs.select("doc_id", T.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term"))
    tf = materialize(words.join(F.broadcast(wanted), "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    n = docs.count()
    worth = terms.join(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").select("item_id", "term", F.log(1 + F.lit(n) / F.col("df")).alias("idf"))
    summed = dealt(tf, docs, "doc_id").join(F.broadcast(worth), "term").groupBy("item_id", "doc_id", "len").agg(F.sum((1 + F.log("tf")) * F.col("idf")).alias("s"))
    scored = summed.select("item_id", "doc_id", F.round(F.col("s") / F.sqrt(1 + F.col("len")), 6).alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
