"""Queries on phrases, recognisers, scenes, people, ranges and tracked questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions import text as T
from caseloom.operators import people, ranges, recognisers, similarity
from caseloom.plans.case_queries import _SENTENCES
from caseloom.plans.registry import query
from caseloom.session import table

#: (sentence places) s(doc_id, pos, sentence), from 0.
_PLACED = f"all_s AS (SELECT doc_id, {_SENTENCES.format('text', 1)} AS ss FROM documents), s AS (SELECT doc_id, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM all_s)"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def values(rows: list[tuple], names: str) -> str:
    """A small table in SQL."""
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


# The rule tables of these queries: phrases of the languages that the documents are in.
FINDS = [("1/who", "of the"), ("1/who", "the of"), ("1/what", "and the"), ("1/where", "in the"), ("1/where", "to the"), ("2/who", "de la"), ("2/who", "la de"), ("2/what", "que"), ("2/where", "en"), ("3/who", "der"), ("3/what", "und die"), ("3/what", "in"), ("3/where", "zu")]
HARMLESS = ["in the and", "of the and", "and the that", "que la", "to the a", "en de", "the the of"]
DENY = ["is the", "le la"]
#: (rule, element, weight, required, anywhere)
ELEMENTS = [("1", "who", 3, True, False), ("1", "what", 2, True, False), ("1", "where", 1, False, False), ("2", "who", 2, True, False), ("2", "what", 1, False, False), ("2", "where", 1, False, True), ("3", "who", 1, True, False), ("3", "what", 2, False, False), ("3", "where", 2, False, True)]
_PHRASES = [(i, p, "find") for i, p in FINDS] + [("h", p, "harmless") for p in HARMLESS] + [("d", p, "deny") for p in DENY]


def phrase_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PHRASES, "phrase_id string, phrase string, kind string")


#: found(doc_id, pos, phrase_id, a, b): every place of every phrase, tried letter by letter.
_HITS = f"""{_PLACED}, phrases AS (SELECT * FROM {values(_PHRASES, 'phrase_id, phrase, kind')}), low AS (SELECT doc_id, pos, lower(sentence) AS low FROM s),
  every AS (SELECT DISTINCT doc_id, pos, phrase_id, kind, i - 1 AS a, i - 1 + length(phrase) AS b FROM (
    SELECT doc_id, pos, low, phrase_id, phrase, kind, unnest(list_filter(range(1, length(low) + 1), lambda i: substring(low, i, length(phrase)) = phrase)) AS i FROM low JOIN phrases ON contains(low, phrase)
  ) WHERE NOT regexp_matches(substring(' ' || low, i, 1), '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(substring(low || ' ', i + length(phrase), 1), '[\\p{{L}}\\p{{N}}]')),
  found AS (SELECT doc_id, pos, phrase_id, a, b FROM every e WHERE kind = 'find' AND NOT EXISTS (SELECT 1 FROM every d WHERE d.kind = 'deny' AND d.doc_id = e.doc_id AND d.pos = e.pos)
    AND NOT EXISTS (SELECT 1 FROM every h WHERE h.kind = 'harmless' AND h.doc_id = e.doc_id AND h.pos = e.pos AND h.a < e.b AND h.b > e.a AND (h.a < e.a OR h.b > e.b)))"""


@query("phrase_hits", f"WITH {_HITS} SELECT doc_id, pos, phrase_id, a::INTEGER AS start, b::INTEGER AS stop FROM found")
def phrase_hits(spark, sf_dir):
    """Places of the rules' phrases in sentences, less those inside harmless phrases."""
    return recognisers.phrase_hits(sentences(spark, sf_dir), ["doc_id", "pos"], "sentence", phrase_table(spark))


@query(
    "recognised_elements",
    f"""WITH {_HITS}, els AS (SELECT * FROM {values(ELEMENTS, 'rule, element, weight, required, anywhere')}),
        own AS (SELECT DISTINCT doc_id, pos, e.* FROM found f JOIN els e ON f.phrase_id = e.rule || '/' || e.element),
        scenes AS (SELECT DISTINCT doc_id, rule, greatest(pos - k, 0) AS scene FROM own, range(3) t(k) WHERE NOT anywhere UNION SELECT doc_id, rule, min(pos) FROM own WHERE anywhere GROUP BY ALL),
        got AS (SELECT DISTINCT c.doc_id, c.rule, c.scene, o.element, o.weight, o.required FROM scenes c JOIN own o ON o.doc_id = c.doc_id AND o.rule = c.rule AND (o.anywhere OR o.pos BETWEEN c.scene AND c.scene + 2)),
        judged AS (SELECT doc_id, g.rule, scene, sum(g.weight) AS score, count(*) FILTER (g.required) AS req, list(element) AS has FROM got g GROUP BY ALL),
        rules AS (SELECT rule, sum(weight) AS most, count(*) FILTER (required) AS req_all, list(element) AS els FROM els GROUP BY 1),
        best AS (SELECT j.*, most, els, req = req_all AS ok FROM judged j JOIN rules USING (rule) QUALIFY row_number() OVER (PARTITION BY doc_id, rule ORDER BY req = req_all DESC, score DESC, req DESC, scene) = 1)
        SELECT doc_id, rule, scene::INTEGER AS scene, ok, CASE WHEN NOT ok THEN 'none' WHEN score >= 0.75 * most THEN 'high' ELSE 'medium' END AS level, score::BIGINT AS score, most::BIGINT AS most,
          array_to_string(list_sort(list_filter(els, lambda x: NOT list_contains(has, x))), ',') AS missing FROM best""",
)
def recognised_elements(spark, sf_dir):
    """Each document's best scene for each rule of weighted elements."""
    els = spark.createDataFrame([(*e, None) for e in ELEMENTS], "rule string, element string, weight long, required boolean, anywhere boolean, least double")
    return recognisers.recognised(sentences(spark, sf_dir), els, phrase_table(spark))


_TOPICS = [("a", "t1", "of the", "find", 2, False), ("a", "t2", "and the", "find", 1, False), ("a", "t3", "to the", "find", 3, False), ("b", "t4", "de la", "find", 1, True), ("b", "t5", "que", "find", 1, False), ("c", "t6", "der", "find", 2, False), ("c", "t7", "die", "find", 1, False), ("c", "t8", "in", "find", 1, False), (None, "h", "of the and", "harmless", 0, False), (None, "d", "is the", "deny", 0, False)]


@query(
    "best_scenes",
    "WITH " + _HITS.replace(values(_PHRASES, "phrase_id, phrase, kind"), values([(r[1], r[2], r[3]) for r in _TOPICS], "phrase_id, phrase, kind"))
    + f""", topics AS (SELECT * FROM {values(_TOPICS, 'topic, phrase_id, phrase, kind, weight, solo')} WHERE topic IS NOT NULL),
        own AS (SELECT DISTINCT doc_id, pos, topic, f.phrase_id, weight, solo FROM found f JOIN topics USING (phrase_id)),
        wins AS (SELECT doc_id, topic, w.pos AS scene, o.phrase_id, o.weight, o.solo, min(o.pos) AS first_at FROM s w JOIN own o USING (doc_id) WHERE o.pos BETWEEN w.pos AND w.pos + 2 GROUP BY ALL),
        got AS (SELECT doc_id, topic, scene, sum(weight) AS score, count(*) AS n, count(*) FILTER (weight >= 2) AS heavy, bool_or(solo) AS solo, min(first_at) AS quote_at FROM wins GROUP BY ALL)
        SELECT doc_id, topic, scene::INTEGER AS scene, solo OR heavy >= 2 OR (heavy >= 1 AND n >= 3) AS strong, score::BIGINT AS score, n AS n_hits, quote_at::INTEGER AS quote_at FROM got
        QUALIFY row_number() OVER (PARTITION BY doc_id, topic ORDER BY (solo OR heavy >= 2 OR (heavy >= 1 AND n >= 3)) DESC, score DESC, scene) = 1""",
)
def best_scenes(spark, sf_dir):
    """The three sentences of each document that show a topic best; in SQL over all windows."""
    phrases = spark.createDataFrame(_TOPICS, "topic string, phrase_id string, phrase string, kind string, weight long, solo boolean")
    return recognisers.best_scenes(sentences(spark, sf_dir), phrases)


_NAMED = """named AS (SELECT l_orderkey AS case_id, CASE l_linenumber % 3 WHEN 0 THEN p_type || ' ' || p_name WHEN 1 THEN p_name ELSE string_split(p_name, ' ')[2] END AS name, l_quantity > 45 AS known
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(
    "resolved_people",
    f"""WITH {_NAMED}, one AS (SELECT case_id, lower(name) AS key, min(name) AS name, count(*) AS mentions, bool_or(known) AS known FROM named WHERE regexp_matches(name, '\\p{{L}}') GROUP BY 1, 2),
        longest AS (SELECT case_id, key FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.case_id = a.case_id AND ends_with(b.key, ' ' || a.key))),
        of AS (SELECT a.case_id, a.key, count(*) AS n, min(b.key) AS person, list_sort(list(b.key)) AS may_be FROM one a JOIN longest b ON b.case_id = a.case_id AND ends_with(b.key, ' ' || a.key) GROUP BY 1, 2)
        SELECT case_id, key, name, mentions, known, CASE WHEN n > 1 THEN key ELSE coalesce(person, key) END AS person,
          CASE WHEN n > 1 THEN 'ambiguous' WHEN NOT contains(coalesce(person, key), ' ') THEN 'partial' ELSE 'clear' END AS status, CASE WHEN n > 1 THEN array_to_string(may_be, ';') END AS may_be
        FROM one LEFT JOIN of USING (case_id, key)""",
)
def resolved_people(spark, sf_dir):
    """Names of each case, short ones resolved to the one full name they end; in SQL pair by pair."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    full, last = F.concat_ws(" ", "p_type", "p_name"), F.split("p_name", " ")[1]
    name = F.when(F.col("l_linenumber") % 3 == 0, full).when(F.col("l_linenumber") % 3 == 1, F.col("p_name")).otherwise(last)
    li = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    out = people.resolved_people(li.select(F.col("l_orderkey").alias("case_id"), name.alias("name"), (F.col("l_quantity") > 45).alias("known")))
    return out.withColumn("may_be", F.array_join("may_be", ";"))


@query(
    "people_aliases",
    f"""WITH {_NAMED}, one AS (SELECT DISTINCT case_id, lower(name) AS key FROM named),
        longest AS (SELECT case_id, key FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.case_id = a.case_id AND ends_with(b.key, ' ' || a.key))),
        of AS (SELECT a.case_id, a.key, min(b.key) AS person FROM one a JOIN longest b ON b.case_id = a.case_id AND (b.key = a.key OR ends_with(b.key, ' ' || a.key)) GROUP BY 1, 2 HAVING count(*) = 1),
        own AS (SELECT DISTINCT case_id, person, unnest([key, person, array_to_string(string_split(person, ' ')[-2:], ' '), string_split(person, ' ')[-1]]) AS alias FROM of WHERE contains(person, ' '))
        SELECT case_id, min(person) AS person, alias FROM own GROUP BY case_id, alias HAVING count(*) = 1""",
)
def people_aliases(spark, sf_dir):
    """Names by which just one clear person of a case can be meant."""
    return people.aliases(resolved_people(spark, sf_dir))


@query(
    "overlapping_terms",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS first, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE + floor(o_totalprice / 800)::INTEGER END AS last FROM orders)
       SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND (b.last IS NULL OR a.first <= b.last) AND (a.last IS NULL OR b.first <= a.last)""",
)
def overlapping_terms(spark, sf_dir):
    """Orders of one customer whose terms, of days to years or without an end, meet."""
    o = table(spark, sf_dir, "orders")
    first = F.to_date("o_orderdate")
    last = F.when(F.col("o_orderstatus") != "P", F.date_add(first, F.floor(F.col("o_totalprice") / 800).cast("int")))
    a = o.select("o_custkey", F.col("o_orderkey").alias("a"), first.alias("first_a"), last.alias("last_a"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("b"), first.alias("first_b"), last.alias("last_b"))
    return ranges.overlapping(a, b, ("first_a", "last_a"), ("first_b", "last_b"), ["o_custkey"]).where("a < b").select("a", "b")


@query(
    "prices_in_bands",
    """WITH band AS (SELECT p_partkey, p_retailprice AS lo, CASE WHEN p_size < 45 THEN p_retailprice + p_size * p_size / 100.0 END AS hi FROM part)
       SELECT s_suppkey, count(*) AS n, min(p_partkey) AS first_part FROM supplier JOIN band ON s_acctbal >= lo AND (hi IS NULL OR s_acctbal < hi) GROUP BY 1""",
)
def prices_in_bands(spark, sf_dir):
    """Bands of very different widths, half open or without an end, that hold each balance."""
    hi = F.when(F.col("p_size") < 45, F.col("p_retailprice") + F.col("p_size") * F.col("p_size") / 100.0)
    band = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), hi.alias("hi"))
    # equal bands and equal balances meet once
    bands = band.where("lo is not null").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("__n"), F.min("p_partkey").alias("__first"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    met = ranges.at_point(suppliers.select("s_acctbal").distinct(), bands, "s_acctbal", "lo", "hi", closed=False)
    held = met.groupBy("s_acctbal").agg(F.sum("__n").alias("n"), F.min("__first").alias("first_part"))
    return suppliers.join(held, "s_acctbal").groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.min("first_part").alias("first_part"))


_VAGUE = r"(^|[^a-z])(of|de|der)([^a-z]|$)"
_KEY = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(
    "tracked_matches",
    rf"""WITH qs AS (SELECT item_id, {_SENTENCES.format('text', 1)} AS ss FROM benchmark), q0 AS (SELECT item_id * 1000 + unnest(range(len(ss))) AS question_id, unnest(ss) AS text FROM qs),
         q AS (SELECT question_id, {_KEY.format('text')} AS key FROM q0), {_PLACED},
         lines AS (SELECT {_KEY.format('sentence')} AS key, trim(coalesce(lead(sentence) OVER (PARTITION BY doc_id ORDER BY pos), '')) AS answer FROM s),
         judged AS (SELECT key, CASE WHEN answer = '' THEN 'empty' WHEN regexp_matches(answer, '{_VAGUE}') AND length(answer) < 160 THEN 'vague' ELSE 'ok' END AS quality FROM lines WHERE key <> ''),
         said AS (SELECT key, count(*) AS n, count(*) FILTER (quality <> 'empty') AS answered, count(*) FILTER (quality = 'ok') AS ok FROM judged GROUP BY 1),
         words AS (SELECT key, list_distinct(list_filter(string_split(key, ' '), lambda w: length(w) > 1)) AS w FROM (SELECT key FROM q UNION SELECT key FROM said)),
         pairs AS (SELECT a.key AS a, b.key AS b, count(*) AS shared FROM (SELECT key, unnest(w) AS t FROM words WHERE key IN (SELECT key FROM q)) a JOIN (SELECT key, unnest(w) AS t FROM words WHERE key IN (SELECT key FROM said)) b USING (t) GROUP BY ALL),
         near AS (SELECT a, b, shared / (len(x.w) + len(y.w) - shared) AS score FROM pairs JOIN words x ON x.key = a JOIN words y ON y.key = b WHERE a <> b UNION ALL SELECT DISTINCT q.key, said.key, 1.0 FROM q JOIN said USING (key) WHERE q.key <> ''),
         hits AS (SELECT question_id, sum(n)::BIGINT AS asked, sum(answered)::BIGINT AS answered, sum(ok) AS ok FROM q JOIN near ON near.a = q.key JOIN said ON said.key = near.b
                  WHERE score >= 0.70 OR (score >= 0.55 AND string_split(q.key, ' ')[1] = string_split(said.key, ' ')[1]) GROUP BY 1)
         SELECT question_id, coalesce(asked, 0) AS asked, coalesce(h.answered, 0) AS answered, CASE WHEN ok > 0 THEN 'answered' WHEN h.answered > 0 THEN 'unclear' WHEN asked > 0 THEN 'asked' ELSE 'open' END AS status
         FROM q LEFT JOIN hits h USING (question_id)""",
)
def tracked_matches(spark, sf_dir):
    """Which sentences of the benchmark the documents ask, in what words, and whether what follows
    answers them. A sentence's first word stands for its issue."""
    from pyspark.sql import Window

    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"))).alias("k", "text"))
    issue = lambda c: F.split(T.match_key(F.col(c)), " ")[0].alias("issue")
    q = items.select((F.col("item_id") * 1000 + F.col("k")).alias("question_id"), issue("text"), "text")
    after = F.lead("sentence").over(Window.partitionBy("doc_id").orderBy("pos"))
    lines = sentences(spark, sf_dir).select(issue("sentence"), F.col("sentence").alias("text"), after.alias("answer"))
    return similarity.tracked(q, lines, _VAGUE).drop("issue")
