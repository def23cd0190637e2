"""Queries of operators.tracking over the driver tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from caseloom.functions import extract as X
from caseloom.operators import relational as R, tracking as K
from caseloom.plans.registry import query
from caseloom.session import table


@query("tenant_rows", "SELECT doc_id, lang FROM documents WHERE source IN ('src3', 'src8')")
def tenant_rows(spark, sf_dir):
    """Documents of two accounts in the open environment."""
    d = table(spark, sf_dir, "documents").withColumn("owner", F.concat(F.lit("u:"), F.col("source")))
    return K.owned_by(d, F.col("owner"), "src3").unionByName(K.owned_by(d, F.col("owner"), "src8")).select("doc_id", "lang")


_STATUS = {"A": "answered", "N": "none", "R": "vague"}


@query("tracked_questions", "SELECT l_orderkey AS plan, l_suppkey % 3 AS issue, l_linenumber AS item, 'vague' AS status FROM lineitem WHERE l_returnflag = 'R'")
def tracked_questions(spark, sf_dir):
    """Questions of one status out of nested plans."""
    li = table(spark, sf_dir, "lineitem").withColumn("status", F.coalesce(*[F.when(F.col("l_returnflag") == k, v) for k, v in _STATUS.items()]))
    issues = li.groupBy(F.col("l_orderkey").alias("plan"), (F.col("l_suppkey") % 3).alias("issue")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("item"), "status")).alias("items"))
    plans = issues.groupBy("plan").agg(F.collect_list(F.struct("issue", "items")).alias("issues"))
    return K.items_of(plans, "vague")


@query(
    "precedent_search",
    """SELECT p_partkey FROM part WHERE p_brand <> 'Brand#23' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49.5) AND (p_size = 7 OR p_type LIKE '%ECON%' OR (contains(lower(p_name || ' ' || p_type), 'bolt') AND contains(lower(p_name || ' ' || p_type), 'small')))""",
)
def precedent_search(spark, sf_dir):
    """Rows of one field value that aren't in the library yet, by number, article or all words."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    found = p.where((F.col("p_brand") != "Brand#23") & ((F.col("p_size") == 7) | F.col("p_type").contains("ECON") | (text.contains("bolt") & text.contains("small"))))
    return found.join(li.where("l_quantity > 49.5").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("pages_without_body", "SELECT page_id, url, html IS NOT NULL AS has_file FROM pages")
def pages_without_body(spark, sf_dir):
    """The list of pages, without their bodies."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").isNotNull().alias("has_file"))


@query(
    "missing_fields",
    """WITH r(kind, field, label) AS (VALUES ('BUILDING', 'name', 'Name'), ('BUILDING', 'nation', 'Nation'), ('FURNITURE', 'phone', 'Phone')),
       v AS (SELECT c_custkey, c_mktsegment AS kind, c_name AS name, CASE WHEN c_acctbal < 0 THEN ' ' ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer)
       SELECT c_custkey, field, label FROM v JOIN r USING (kind) WHERE NOT ((field = 'name' AND trim(name) <> '') OR (field = 'nation' AND trim(nation) <> ''))""",
)
def missing_fields(spark, sf_dir):
    """Required fields that are blank or absent, by kind of record."""
    rules = spark.sql("SELECT * FROM VALUES ('BUILDING', 'name', 'Name'), ('BUILDING', 'nation', 'Nation'), ('FURNITURE', 'phone', 'Phone') AS t(kind, field, label)")
    nation = F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_nationkey").cast("string"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("kind"), F.explode(F.create_map(F.lit("name"), F.col("c_name"), F.lit("nation"), nation)).alias("field", "value"))
    return K.missing_fields(c, F.broadcast(rules), "c_custkey")


@query("point_lookup", "SELECT o_orderkey, c_name AS party FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'")
def point_lookup(spark, sf_dir):
    """Each record with the party of its key, null where there is none."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("party"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left").select("o_orderkey", "party")


@query("range_bucket", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'I' WHEN p_size <= 25 THEN 'II' WHEN p_size <= 40 THEN 'III' END AS chapter FROM part")
def range_bucket(spark, sf_dir):
    """Chapter of each number by upper bounds."""
    return table(spark, sf_dir, "part").select("p_partkey", K.range_bucket(F.col("p_size"), [(10, "I"), (25, "II"), (40, "III")]).alias("chapter"))


@query(
    "records_of_plans",
    """WITH p AS (SELECT c_custkey AS plan_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS case_id, c_custkey % 5 AS article, c_mktsegment AS role FROM customer WHERE c_custkey % 3 = 0),
       r AS (SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS plan_id, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS case_id, s_suppkey % 5 AS article, CASE WHEN s_acctbal > 4000 THEN 'BUILDING' ELSE 'FURNITURE' END AS role FROM supplier)
       SELECT p.plan_id, r.record_id FROM p JOIN r ON CASE WHEN r.plan_id IS NOT NULL THEN r.plan_id = p.plan_id ELSE r.case_id IS NOT DISTINCT FROM p.case_id AND r.article = p.article AND r.role = p.role END""",
)
def records_of_plans(spark, sf_dir):
    """Records of each plan, by its id or by case, article and role."""
    p = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("plan_id"), F.expr("if(c_custkey % 4 = 0, null, c_nationkey)").alias("case_id"), (F.col("c_custkey") % 5).alias("article"), F.col("c_mktsegment").alias("role"))
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id"), F.expr("if(s_suppkey % 2 = 0, s_suppkey, null)").alias("plan_id"), F.expr("if(s_suppkey % 7 = 0, null, s_nationkey)").alias("case_id"), (F.col("s_suppkey") % 5).alias("article"), F.expr("if(s_acctbal > 4000, 'BUILDING', 'FURNITURE')").alias("role"))
    return K.records_of_plans(p, r)


@query(
    "answers_matched_once",
    """WITH q AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS pl, l_linenumber % 3 AS key FROM lineitem),
       a AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS pl, l_linenumber % 4 AS key FROM lineitem WHERE l_linenumber > 1),
       qn AS (SELECT *, row_number() OVER (PARTITION BY g, key ORDER BY pl) AS n FROM q), an AS (SELECT *, row_number() OVER (PARTITION BY g, key ORDER BY pl) AS n FROM a),
       e AS (SELECT qn.g, qn.pl AS p_at, an.pl AS g_at FROM qn JOIN an USING (g, key, n)),
       ql AS (SELECT g, pl, row_number() OVER (PARTITION BY g ORDER BY pl) AS n FROM q WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.g = q.g AND e.p_at = q.pl)),
       al AS (SELECT g, pl, row_number() OVER (PARTITION BY g ORDER BY pl) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.g = a.g AND e.g_at = a.pl))
       SELECT g AS case_id, p_at, g_at FROM e UNION ALL SELECT ql.g, ql.pl, al.pl FROM ql JOIN al USING (g, n)""",
)
def answers_matched_once(spark, sf_dir):
    """Pasted answers dealt to pending questions, each once."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("at")).distinct()
    return K.match_once(li.withColumn("key", F.col("at") % 3), li.where("at > 1").withColumn("key", F.col("at") % 4), "case_id", "key", "at")


@query(
    "catalogue_with_library",
    """SELECT p.p_partkey, l.best AS held_at FROM part p LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS best FROM lineitem WHERE l_quantity > 40 GROUP BY 1) l ON l.l_partkey = p.p_partkey""",
)
def catalogue_with_library(spark, sf_dir):
    """Catalogue numbers with the last library entry of the same number, however it is written."""
    cat = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("0"), F.col("p_partkey").cast("string"), F.lit("/al")).alias("number"))
    lib = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.concat_ws(" / ", F.col("l_partkey").cast("string"), F.lit("AL")).alias("number"), "l_shipdate")
    return K.catalogue_with_library(cat, lib, "number", "l_shipdate").select("p_partkey", F.col("in_library.l_shipdate").alias("held_at"))


@query("related_precedents", "SELECT conv_id FROM (SELECT conv_id, list(DISTINCT role) AS roles, max(turn) AS n FROM conversations GROUP BY 1) WHERE list_has_any(roles, ['system', 'tool']) AND n > 2")
def related_precedents(spark, sf_dir):
    """Records whose list of marks meets a given list."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.max("turn").alias("n"))
    return c.where(F.arrays_overlap("roles", F.array(F.lit("system"), F.lit("tool"))) & (F.col("n") > 2)).select("conv_id")


@query(
    "denied_claims",
    """WITH s AS (SELECT l_orderkey AS c, l_linenumber AS line, l_suppkey % 4 AS speaker, l_linestatus AS kind, l_partkey % 3 AS a, l_suppkey % 3 AS b, l_returnflag = 'R' AS denies FROM lineitem)
       SELECT d.c AS case_id, d.line, d.speaker, CASE WHEN EXISTS (SELECT 1 FROM s x WHERE x.c = d.c AND x.kind = d.kind AND NOT x.denies AND x.speaker <> d.speaker AND least(x.a, x.b) = least(d.a, d.b) AND greatest(x.a, x.b) = greatest(d.a, d.b)) THEN 'contradicted' ELSE 'denied' END AS finding FROM s d WHERE d.denies""",
)
def denied_claims(spark, sf_dir):
    """Denials, and whether another speaker claims what they deny."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 4).alias("speaker"), F.col("l_linestatus").alias("kind"), (F.col("l_partkey") % 3).alias("a"), (F.col("l_suppkey") % 3).alias("b"), (F.col("l_returnflag") == "R").alias("denies"))
    return K.denials(s)


@query(
    "element_matrix",
    """WITH e(element) AS (VALUES (0), (1), (2), (3)), s AS (SELECT l_orderkey AS c, l_partkey % 4 AS element, l_suppkey AS source, l_returnflag AS kind FROM lineitem WHERE l_linestatus <> 'F')
       SELECT o_orderkey AS case_id, CAST(e.element AS BIGINT) AS element, count(DISTINCT source) AS sources, coalesce(bool_and(kind = 'A'), false) AS confession_only FROM orders CROSS JOIN e LEFT JOIN s ON s.c = o_orderkey AND s.element = e.element GROUP BY 1, 2""",
)
def element_matrix(spark, sf_dir):
    """Elements of each case, the sources that support them, and those that rest on confessions alone."""
    elements = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("element"))
    s = table(spark, sf_dir, "lineitem").where("l_linestatus <> 'F'").select(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 4).cast("bigint").alias("element"), F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("kind"))
    return K.element_matrix(elements, s, F.col("kind") == "A")


@query("rules_with_overrides", "SELECT n_nationkey, CASE WHEN s > 0 THEN s ELSE CAST(n_nationkey + 1 AS DOUBLE) END AS days FROM nation LEFT JOIN (SELECT s_nationkey, min(s_acctbal)::DOUBLE AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def rules_with_overrides(spark, sf_dir):
    """Default terms, with saved ones where they are above 0."""
    d = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 1).cast("double").alias("days"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_acctbal").cast("double").alias("days"))
    return K.with_overrides(d, s, "n_nationkey", "days")


@query(
    "rebuilt_catalogue",
    """WITH a AS (SELECT n_nationkey AS k, n_name AS t FROM nation), b AS (SELECT r_regionkey * 20 AS k, r_name AS t FROM region),
       u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a))
       SELECT k, CASE WHEN k % 5 = 0 THEN 'official ' || k ELSE t END AS t FROM u WHERE k % 7 <> 3""",
)
def rebuilt_catalogue(spark, sf_dir):
    """Curated and generated entries, official texts first, repealed ones left out."""
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("t"))
    b = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 20).cast("long").alias("k"), F.col("r_name").alias("t"))
    ids = spark.range(200).withColumnRenamed("id", "k")
    official = ids.where("k % 5 = 0").withColumn("t", F.concat(F.lit("official "), F.col("k").cast("string")))
    return K.rebuilt_catalogue(a, b, official, ids.where("k % 7 = 3"), "k", "t")


@query(
    "issues_without_overlap",
    """WITH a AS (SELECT DISTINCT l_orderkey AS g, l_partkey % 500 AS s, l_partkey % 500 + 12 AS e FROM lineitem WHERE l_linenumber % 2 = 0), b AS (SELECT l_orderkey AS g, l_suppkey * 7 % 500 AS s, CASE WHEN l_quantity < 49 THEN l_suppkey * 7 % 500 + CASE WHEN l_quantity < 40 THEN 20 ELSE 400 END END AS e FROM lineitem WHERE l_linenumber % 2 = 1)
       SELECT g AS doc, s AS start, e AS stop FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.g = a.g AND (b.e IS NULL OR a.s < b.e) AND b.s < a.e)""",
)
def issues_without_overlap(spark, sf_dir):
    """Spans of one finder that meet none of another's in the same text."""
    li = table(spark, sf_dir, "lineitem")
    a = li.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 500).alias("start")).distinct().withColumn("stop", F.col("start") + 12)
    long = F.when(F.col("l_quantity") < 40, 20).when(F.col("l_quantity") < 49, 400)  # or without an end
    b = li.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") * 7 % 500).alias("start"), (F.col("l_suppkey") * 7 % 500 + long).alias("stop"))
    return K.without_overlaps(a, b, "doc", "start", "stop")


@query("usage_counters", "SELECT event_type AS kind, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1")
def usage_counters(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_at"))


@query(
    "amount_quotes",
    """WITH d AS (SELECT DISTINCT l_suppkey, l_quantity, l_returnflag || l_linestatus AS said FROM lineitem), q AS (SELECT l_suppkey, l_quantity, list(said ORDER BY said)[1:3] AS modes FROM d GROUP BY 1, 2)
       SELECT l_suppkey AS party, CAST(l_quantity AS DOUBLE) AS amount, n, array_to_string(modes, ',') AS quotes FROM q JOIN (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2) USING (l_suppkey, l_quantity)""",
)
def amount_quotes(spark, sf_dir):
    """Distinct amounts of each party: how often, and up to three different quotes. A quote is
    counted once before it is gathered, and three are kept per amount before they meet."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("party"), F.col("l_quantity").cast("double").alias("amount"), F.concat("l_returnflag", "l_linestatus").alias("said")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("party", "amount").orderBy("said")
    quotes = F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.col("said"))))
    return g.withColumn("k", F.row_number().over(w)).groupBy("party", "amount").agg(F.sum("c").alias("n"), F.array_join(quotes, ",").alias("quotes"))


@query("speaker_profiles", "SELECT l_suppkey AS speaker, count(*) FILTER (l_returnflag = 'N') AS claims, count(*) FILTER (l_returnflag = 'R') AS denials, count(*) FILTER (l_returnflag = 'A') AS vague, count(DISTINCT l_orderkey) AS cases FROM lineitem GROUP BY 1")
def speaker_profiles(spark, sf_dir):
    """Claims, denials and vague answers of each speaker."""
    f = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("speaker")).agg(F.count_if(f == "N").alias("claims"), F.count_if(f == "R").alias("denials"), F.count_if(f == "A").alias("vague"), F.count_distinct("l_orderkey").alias("cases"))


@query(
    "citation_counts",
    """SELECT CAST(o_custkey % 90 + 1 AS VARCHAR) AS article, count(*) AS n FROM orders WHERE (o_custkey % 90 + 1) IN (SELECT n_nationkey * 2 FROM nation) GROUP BY 1""",
)
def citation_counts(spark, sf_dir):
    """How often each known article is cited."""
    said = F.concat(F.lit("theo khoản 1 Điều "), (F.col("o_custkey") % 90 + 1).cast("string"), F.lit(" và các quy định khác"))
    cited = table(spark, sf_dir, "orders").select(F.explode(X.citations(said)).alias("c")).select("c.article")
    known = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2).cast("string").alias("article"))
    return cited.join(F.broadcast(known), "article", "left_semi").groupBy("article").agg(F.count(F.lit(1)).alias("n"))


@query("severity_max", "SELECT l_orderkey, ['red', 'yellow', 'green'][min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END)] AS level FROM lineitem GROUP BY 1")
def severity_max(spark, sf_dir):
    """The gravest level of each case."""
    level = F.when(F.col("l_returnflag") == "R", "red").when(F.col("l_returnflag") == "A", "yellow").otherwise("green")
    return table(spark, sf_dir, "lineitem").withColumn("level", level).groupBy("l_orderkey").agg(F.min_by("level", K.ranked(F.col("level"), ["red", "yellow", "green"])).alias("level"))


@query("heaviest_class", "SELECT p_brand, CASE WHEN max(p_size) * 6 <= 36 THEN 'minor' WHEN max(p_size) * 6 <= 84 THEN 'serious' WHEN max(p_size) * 6 <= 180 THEN 'grave' ELSE 'gravest' END AS class FROM part GROUP BY 1")
def heaviest_class(spark, sf_dir):
    """Class of the longest term of each group, by months."""
    m = F.max(F.col("p_size") * 6)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.coalesce(K.range_bucket(m, [(36, "minor"), (84, "serious"), (180, "grave")]), F.lit("gravest")).alias("class"))


@query("store_stats", "SELECT source AS owner, count(*) FILTER (text IS NULL) AS sealed, count(*) FILTER (text IS NOT NULL) AS plain, count(DISTINCT lang) AS langs FROM documents GROUP BY 1")
def store_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("owner")).agg(F.count_if(F.col("text").isNull()).alias("sealed"), F.count_if(F.col("text").isNotNull()).alias("plain"), F.count_distinct("lang").alias("langs"))


@query(
    "quality_scores",
    """SELECT l_orderkey AS doc, CAST(greatest(0, floor(100 - sum(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) * 250.0 / sum(l_quantity * 4) + 0.5)) AS BIGINT) AS score FROM lineitem GROUP BY 1""",
)
def quality_scores(spark, sf_dir):
    """100 less the weight of the issues per word, times 250."""
    weight = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.sum(weight).alias("w"), F.sum(F.col("l_quantity") * 4).alias("n"))
    return g.select("doc", F.greatest(F.lit(0), F.floor(100 - F.col("w") * 250.0 / F.col("n") + 0.5)).cast("long").alias("score"))


@query(
    "learned_questions",
    """WITH n AS (SELECT role AS bank, lower(trim(text)) AS question, count(*) AS n, max(turn) AS last_at FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2)
       SELECT bank, md5(question) AS question, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY n DESC, last_at DESC, question) AS rank FROM n) WHERE rank <= 40""",
)
def learned_questions(spark, sf_dir):
    """The 40 most frequent questions of each bank."""
    c = table(spark, sf_dir, "conversations").where("text is not null").groupBy(F.col("role").alias("bank"), F.lower(F.trim("text")).alias("question")).agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_at"))
    return R.capped(c, ["bank"], [F.desc("n"), F.desc("last_at"), F.asc("question")], 40).select("bank", F.md5("question").alias("question"), "n", "rank")


@query(
    "questions_by_person",
    """WITH f AS (SELECT l_orderkey AS case_id, l_suppkey % 3 AS person, l_returnflag || l_linestatus AS q, min(l_linenumber) AS first_at FROM lineitem GROUP BY 1, 2, 3)
       SELECT case_id, person, string_agg(q, '|' ORDER BY first_at, q) AS questions FROM f GROUP BY 1, 2""",
)
def questions_by_person(spark, sf_dir):
    """Questions to each person, each once, in the order in which they came up first."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 3).alias("person"), F.concat("l_returnflag", "l_linestatus").alias("q")).agg(F.min("l_linenumber").alias("at"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "q")))
    return f.groupBy("case_id", "person").agg(ordered.alias("qs")).select("case_id", "person", F.array_join(F.transform("qs", lambda x: x["q"]), "|").alias("questions"))


@query(
    "login_lockouts",
    """WITH e AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
       n AS (SELECT *, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM e)
       SELECT event_id, user_id, CAST(5 * power(2, n / 5 - 1) AS INTEGER) AS minutes FROM n WHERE event_type = 'click' AND n % 5 = 0""",
)
def login_lockouts(spark, sf_dir):
    """Every fifth failure locks, each time twice as long, until a success."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return K.lockouts(e, "user_id", ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase").select("event_id", "user_id", "minutes")


@query("urgent_first", "SELECT o_orderkey, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS place FROM orders")
def urgent_first(spark, sf_dir):
    """Each party's records by urgency, then date."""
    w = Window.partitionBy("o_custkey").orderBy(K.ranked(F.col("o_orderstatus"), ["F", "O"]), "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.row_number().over(w).alias("place"))


@query(
    "pinned_top",
    """WITH r AS (SELECT p_brand AS g, p_partkey AS name, p_size % 6 AS family, CASE WHEN p_partkey % 50 = 0 THEN 'pinned' WHEN p_partkey % 20 = 0 THEN 'recogniser' ELSE 'words' END AS source, p_size AS score FROM part),
       f AS (SELECT * FROM r WHERE source <> 'words'),
       w AS (SELECT g, name, family, source, score FROM (SELECT r.*, max(score) OVER (PARTITION BY g) AS best FROM r) x WHERE source = 'words' AND score >= 0.35 * best AND NOT EXISTS (SELECT 1 FROM f WHERE f.g = x.g AND f.family = x.family) QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, name) <= 2)
       SELECT g, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY CASE source WHEN 'pinned' THEN 0 WHEN 'recogniser' THEN 1 ELSE 2 END, score DESC, name) AS rank FROM (SELECT * FROM f UNION ALL SELECT * FROM w)) WHERE rank <= 5""",
)
def pinned_top(spark, sf_dir):
    """Five suggestions of each group: pinned, recognised, then by words."""
    source = F.when(F.col("p_partkey") % 50 == 0, "pinned").when(F.col("p_partkey") % 20 == 0, "recogniser").otherwise("words")
    r = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("name"), (F.col("p_size") % 6).alias("family"), source.alias("source"), F.col("p_size").alias("score"))
    return K.shown(r, "g").select("g", "name", "rank")


@query("article_order", "SELECT o_orderkey, CAST((o_orderkey % 400) * 10 + CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 5 ELSE 0 END AS INTEGER) AS place FROM orders")
def article_order(spark, sf_dir):
    """Sort keys of article numbers with letters."""
    letter = F.when(F.col("o_orderkey") % 5 == 1, "a").when(F.col("o_orderkey") % 5 == 2, "b").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", K.article_order(F.concat((F.col("o_orderkey") % 400).cast("string"), letter)).alias("place"))


@query(
    "case_warnings",
    """WITH a AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS age, o_orderstatus FROM orders)
       SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND age >= 30 THEN 'high' WHEN o_orderstatus = 'O' AND age >= 3 THEN 'middle' ELSE 'low' END AS level, CASE WHEN o_orderstatus = 'O' AND age >= 30 THEN 0 WHEN o_orderstatus = 'O' AND age >= 3 THEN 1 ELSE 2 END AS place FROM a WHERE o_orderstatus <> 'F'""",
)
def case_warnings(spark, sf_dir):
    """Open records by the days they wait: 30 and 3."""
    age = F.datediff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate"))
    open_ = F.col("o_orderstatus") == "O"
    level = F.when(open_ & (age >= 30), "high").when(open_ & (age >= 3), "middle").otherwise("low")
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", level.alias("level"))
    return o.withColumn("place", K.ranked(F.col("level"), ["high", "middle", "low"]))


@query("text_hashes", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def text_hashes(spark, sf_dir):
    """Cache keys of texts."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))


@query(
    "record_texts",
    """SELECT conv_id, md5(string_agg(upper(coalesce(role, '')) || ': ' || trim(coalesce(text, '')), chr(10) ORDER BY turn, role, text)) AS digest, count(*) AS n FROM conversations GROUP BY 1""",
)
def record_texts(spark, sf_dir):
    """Records written out as plain text, a line for each turn."""
    line = F.concat_ws(": ", F.upper(F.coalesce("role", F.lit(""))), F.trim(F.coalesce("text", F.lit(""))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("ls"))
    return c.select("conv_id", F.md5(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("digest"), F.size("ls").cast("long").alias("n"))


@query("admin_dates", "SELECT o_orderkey, 'ngày ' || CASE WHEN day(o_orderdate) < 10 THEN '0' ELSE '' END || day(o_orderdate) || ' tháng ' || CASE WHEN month(o_orderdate) < 3 THEN '0' ELSE '' END || month(o_orderdate) || ' năm ' || year(o_orderdate) AS written FROM orders")
def admin_dates(spark, sf_dir):
    """Dates as offices write them: days under 10 and the first two months with a zero."""
    d = F.to_date("o_orderdate")
    day, month = F.dayofmonth(d).cast("string"), F.month(d).cast("string")
    pad = lambda n, below: F.when(n.cast("int") < below, F.concat(F.lit("0"), n)).otherwise(n)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("ngày "), pad(day, 10), F.lit(" tháng "), pad(month, 3), F.lit(" năm "), F.year(d).cast("string")).alias("written"))


@query("distinct_estimate", "SELECT event_type, count(DISTINCT user_id) AS exact, count(DISTINCT date_trunc('day', ts)) AS n_days, true AS merged_close, true AS days_agree FROM events GROUP BY 1")
def distinct_estimate(spark, sf_dir):
    """Users of each kind of event, exactly, and by sketches that are kept for each day and merged: within 5 % (or 2) of the exact
    number, and equal to one sketch of all days, as a union of sketches loses nothing."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = e.groupBy("event_type", "day").agg(F.hll_sketch_agg("user_id", 14).alias("sketch"))
    merged = days.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("merged"), F.count(F.lit(1)).alias("n_days"))
    whole = e.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 14)).alias("whole"), F.count_distinct("user_id").alias("exact"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(0.05 * F.col("exact"), F.lit(2))
    return merged.join(whole, "event_type").select("event_type", "exact", "n_days", near("merged", "exact").alias("merged_close"), near("merged", "whole").alias("days_agree"))


@query(
    "act_matches",
    """WITH s AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w, lower(p_name) AS t, ['small', 'blue', 'ring', 'bolt'] AS a FROM part)
       , b AS (SELECT *, list_distinct(list_transform(range(1, len(w)::BIGINT), lambda i: w[i] || ' ' || w[i + 1])) AS pw, ['small blue', 'blue ring', 'ring bolt'] AS pa FROM s)
       , c AS (SELECT p_partkey, t, len(list_intersect(pa, pw)) AS nb, len(list_intersect(a, w)) AS nu FROM b)
       , d AS (SELECT p_partkey, CASE WHEN contains(t, 'small') THEN greatest(0.7, least(1.0, nb / 3 * 0.75 + nu / 4 * 0.35)) WHEN nb >= 2 AND nb / 3 >= 0.25 THEN least(1.0, nb / 3 * 0.75 + nu / 4 * 0.35) END - CASE WHEN p_partkey % 2 = 0 THEN 0.3 ELSE 0 END AS score FROM c)
       SELECT p_partkey, round(score, 6) AS score FROM d WHERE score >= 0.34""",
)
def act_matches(spark, sf_dir):
    """How well an act's words fit each text."""
    low = F.lower("p_name")
    act = F.array(*map(F.lit, ("small", "blue", "ring", "bolt")))
    p = table(spark, sf_dir, "part").select("p_partkey", K.act_match(act, F.split(low, " "), F.lit("small"), low, F.col("p_partkey") % 2 == 0).alias("score"))
    return p.where("score is not null").select("p_partkey", F.round("score", 6).alias("score"))
