"""Queries on keyed collections, damaged JSON and searches over all stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import search as S
from caseloom.plans.registry import _FOLD, query
from caseloom.session import table
from caseloom.sources import collections as C


def _orders(spark, sf_dir):
    """One collection per customer: its orders by key, with their lines."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("qty")))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), F.struct(F.col("o_orderstatus").alias("status"), "lines"))))).alias("json"))


@query(
    "collection_leaves",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INTEGER AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity::INTEGER) - 1 AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
       SELECT o_custkey, o_orderkey::VARCHAR AS record, '$[''status'']' AS path, o_orderstatus AS value FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
       UNION ALL SELECT o_custkey, o_orderkey::VARCHAR, '$[''lines''][' || k || '][''' || f || ''']', v FROM orders JOIN l ON l_orderkey = o_orderkey, LATERAL (SELECT unnest(['no', 'part', 'qty']) AS f, unnest([l_linenumber::VARCHAR, l_partkey::VARCHAR, q::VARCHAR]) AS v)""",
)
def collection_leaves(spark, sf_dir):
    """Every value of every record of the collections, with its path."""
    return C.leaves(C.records(_orders(spark, sf_dir), ["o_custkey"], "json"), ["o_custkey", "record"]).drop("kind")


@query(
    "path_values",
    """SELECT o_custkey, o_orderkey::VARCHAR AS record, o_orderstatus AS status, (SELECT arg_min(l_partkey, (l_linenumber, l_partkey, l_quantity::INTEGER)) FROM lineitem WHERE l_orderkey = o_orderkey) AS first_part, NULL::VARCHAR AS missing
       FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
)
def path_values(spark, sf_dir):
    """Values of each record by path."""
    r = C.records(_orders(spark, sf_dir), ["o_custkey"], "json")
    return r.select("o_custkey", "record", C.at_path(F.col("value"), "$.status").alias("status"), C.at_path(F.col("value"), "$.lines[0].part", "long").alias("first_part"), C.at_path(F.col("value"), "$.lines[999].part").alias("missing"))


@query(
    "salvaged_json",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN replace(props, ' ', '') WHEN 1 THEN '{"id":' || event_id || ',"all":[{"a":1}]}' WHEN 2 THEN NULL ELSE '{"id":' || event_id || '}' END AS json FROM events""",
)
def salvaged_json(spark, sf_dir):
    """Objects inside prose, whole ones and ones that are cut short at several places."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id").cast("string")
    said = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Here it is: "), "props", F.lit(" and {more}.")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('```json\n{"id": '), k, F.lit(', "all": [{"a": 1}, {"a": 2, "b": "un')))
        .when(F.col("event_id") % 4 == 2, F.lit("no object"))
        .otherwise(F.concat(F.lit('{"id": '), k, F.lit(', "text": "a \\" quote, and a comma')))
    )
    return e.select("event_id", C.salvaged(said).alias("json"))


def _has(text: str, word: str) -> str:
    return f"regexp_matches({_FOLD.format(text)}, '(^|[^a-z0-9]){word}')"


@query(
    "store_search",
    f"""WITH r AS (SELECT 'document' AS kind, doc_id AS id, lang || ' ' || source AS title, text FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, role, text FROM conversations UNION ALL SELECT 'item', item_id, 'item', text FROM benchmark),
        h AS (SELECT *, {_has("title", "en")} AND {_has("title", "the")} AS in_title FROM r WHERE {_has("title || ' ' || text", "en")} AND {_has("title || ' ' || text", "the")})
        SELECT kind, id, in_title, rank, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY in_title DESC, id) AS rank, count(*) OVER (PARTITION BY kind) AS n FROM h) WHERE rank <= 20""",
)
def store_search(spark, sf_dir):
    """Rows of three stores that have words which begin with en and the."""
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.concat_ws(" ", "lang", "source").alias("title"), "text")
    c = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("title"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.lit("item").alias("title"), "text")
    return S.search(d.unionByName(c).unionByName(b), "En, THE").drop("snippet")


@query(
    "catalogue_search",
    """SELECT number, place, score FROM (SELECT p_partkey::VARCHAR AS number, p_partkey AS place,
         (p_partkey = 7)::INT * 100 + contains(lower(p_name), '7')::INT * 40 + (contains(lower(p_type), '7') OR contains(lower(p_brand), '7'))::INT * 20 + contains(p_size || ' ' || p_size * 7, '7')::INT * 5 AS score FROM part) WHERE score > 0""",
)
def catalogue_search(spark, sf_dir):
    """Entries of a catalogue by number, name, acts and signs."""
    text = lambda c: F.col(c).cast("string")
    p = table(spark, sf_dir, "part").select(text("p_partkey").alias("number"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("acts"), F.array(text("p_size"), (F.col("p_size") * 7).cast("string")).alias("signs"), F.col("p_partkey").alias("place"))
    return S.search_catalogue(p, " 7 ")


@query(
    "candidate_ranking",
    """WITH r AS (SELECT l_orderkey, l_partkey % 50 AS article, bool_or(l_returnflag = 'A') AS c, bool_or(l_linestatus = 'F') AS p, bool_or(l_quantity > 25) AS s, bool_or(l_discount > 0.05 AND l_quantity > 25) AS l, bool_or(l_tax > 0.04) AS t, max(l_linenumber) AS e FROM lineitem GROUP BY 1, 2)
       SELECT l_orderkey, article, c::INT * 100 + p::INT * 90 + s::INT * 50 + l::INT * 10 + t::INT * 8 + e AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY c::INT * 100 + p::INT * 90 + s::INT * 50 + l::INT * 10 + t::INT * 8 + e DESC, article) AS rank FROM r QUALIFY rank <= 8""",
)
def candidate_ranking(spark, sf_dir):
    """The eight articles of each case that most speaks for."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", (F.col("l_partkey") % 50).alias("article"), (F.col("l_returnflag") == "A").alias("cited"), (F.col("l_linestatus") == "F").alias("is_primary"), (F.col("l_quantity") > 25).alias("shown"), F.when(F.col("l_discount") > 0.05, "high").alias("level"), (F.col("l_tax") > 0.04).alias("seeded"), F.col("l_linenumber").alias("evidence"))
    return S.ranked_candidates(rows, "l_orderkey")
