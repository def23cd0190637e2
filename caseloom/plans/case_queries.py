"""Queries of the document operators, measures and merges, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import measures as M
from caseloom.operators import documents as D
from caseloom.plans.registry import _FOLD, _TOKENS, query
from caseloom.session import table

_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({}, '([.!?…])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: length(s) >= {})"


@query(
    "statement_split",
    """SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS part, 'turn ' || turn AS speaker, role, md5(rtrim(text, chr(10) || ' ')) AS text_md5 FROM conversations""",
)
def statement_split(spark, sf_dir):
    """Turns of a conversation written as one record with headings, cut into statements again."""
    block = F.concat(F.lit("Statement of turn "), F.col("turn").cast("string"), F.lit(" ("), F.col("role"), F.lit(")\n"), F.coalesce("text", F.lit("")))
    turns = F.sort_array(F.collect_list(F.struct("turn", block.alias("b"))))
    whole = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(turns, lambda r: r["b"]), "\n").alias("text"))
    return D.split_statements(whole, r"Statement of (turn \d+) \((\w+)\)").select("doc_id", "part", "speaker", "role", F.md5(F.rtrim(F.col("text"))).alias("text_md5"))


@query(
    "information_filter",
    rf"""WITH s AS (SELECT doc_id, text, {_SENTENCES.format('text', 12)} AS s FROM documents),
         k AS (SELECT doc_id, text, list_filter(s, lambda x: regexp_matches(x, '[0-9,]') AND NOT regexp_matches(x, '(?i)copyright|licen[cs]e')) AS f FROM s),
         u AS (SELECT doc_id, text, list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: lower(y)), lower(x)) = i) AS f FROM k)
         SELECT doc_id, md5(CASE WHEN length(text) > 600 AND length(array_to_string(f, ' ')) >= 0.25 * length(text) THEN array_to_string(f, ' ') ELSE text END) AS text_md5,
           CASE WHEN length(text) > 600 AND length(array_to_string(f, ' ')) >= 0.25 * length(text) THEN len(f) ELSE -1 END AS n_kept FROM u""",
)
def information_filter(spark, sf_dir):
    """Sentences with figures or clauses, without licence lines, each once."""
    out = D.information_filter(table(spark, sf_dir, "documents"), r"[0-9,]", r"(?i)copyright|licen[cs]e", least=600)
    return out.select("doc_id", F.md5("text").alias("text_md5"), "n_kept")


@query(
    "keyword_frequency",
    rf"""WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents),
         g AS (SELECT doc_id, unnest(w) AS term, 1.0 AS x FROM t UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1], 1.6 FROM t, unnest(range(1, len(w)::BIGINT)) AS r(i)),
         c AS (SELECT doc_id, term, CAST(sum(x) AS DOUBLE) AS weight FROM g GROUP BY ALL HAVING sum(x) >= 2),
         r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS o FROM c),
         b AS (SELECT doc_id, unnest(string_split(term, ' ')) AS word, o FROM r WHERE contains(term, ' ')),
         f AS (SELECT doc_id, word, min(o) AS o FROM b GROUP BY ALL)
         SELECT doc_id, term, round(weight, 6) AS weight, rank FROM (
           SELECT r.doc_id, r.term, r.weight, row_number() OVER (PARTITION BY r.doc_id ORDER BY weight DESC, term) AS rank
           FROM r LEFT JOIN f ON f.doc_id = r.doc_id AND f.word = r.term AND f.o < r.o WHERE f.o IS NULL) WHERE rank <= 8""",
)
def keyword_frequency(spark, sf_dir):
    """Eight words and word pairs that stand for each document."""
    return D.keyword_frequency(table(spark, sf_dir, "documents"))


@query(
    "summary_sentences",
    rf"""WITH a AS (SELECT doc_id, {_SENTENCES.format('text', 1)} AS ss FROM documents), s AS (SELECT doc_id, len(ss) AS n, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM a),
         t AS (SELECT *, {_TOKENS.format('sentence')} AS terms, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w: w <> '')) AS words FROM s),
         df AS (SELECT doc_id, term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(terms)) AS term FROM t) GROUP BY ALL), w AS (SELECT doc_id, term, df / max(df) OVER (PARTITION BY doc_id) AS w FROM df),
         g AS (SELECT doc_id, pos, sum(w) AS total FROM (SELECT doc_id, pos, unnest(terms) AS term FROM t) JOIN w USING (doc_id, term) GROUP BY ALL),
         c AS (SELECT doc_id, pos, n, sentence, round(total / sqrt(len(terms)) * CASE WHEN pos = 0 THEN 1.35 WHEN pos = n - 1 THEN 1.1 ELSE 1.0 END * CASE WHEN words < 5 THEN 0.5 ELSE 1.0 END, 6) AS score FROM t JOIN g USING (doc_id, pos))
         SELECT doc_id, pos::INTEGER AS pos, score, md5(sentence) AS sentence_md5 FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) <= ceil(n * 0.3)""",
)
def summary_sentences(spark, sf_dir):
    """Extractive summary: places and scores of the best third of each document's sentences."""
    return D.summary_sentences(table(spark, sf_dir, "documents")).select("doc_id", "pos", "score", F.md5("sentence").alias("sentence_md5"))


@query(
    "carry_down",
    """SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS context,
         CASE WHEN event_type = 'purchase' THEN coalesce(event_id > max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) END AS in_order
       FROM (SELECT event_id, user_id, event_type, ts FROM events)""".replace("max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS context", "last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context"),
)
def carry_down(spark, sf_dir):
    """Each event under its user's last purchase, as articles stand under chapters."""
    return D.carry_down(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id")).select("event_id", "context", "in_order")


@query(
    "adjacent_runs",
    """WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM m)
       SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY ALL""",
)
def adjacent_runs(spark, sf_dir):
    """Table of contents: adjacent entries of one kind merged."""
    return D.adjacent_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(
    "name_suffix_match",
    rf"""WITH n AS (SELECT DISTINCT 'Land ' || r_name || ' ' || n_name AS full_name, r_name || ' ' || n_name AS short_name FROM nation JOIN region ON r_regionkey = n_regionkey),
         t AS (SELECT full_name, array_to_string(string_split(trim(regexp_replace({_FOLD.format('full_name')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')[-2:], ' ') AS tail FROM n),
         o AS (SELECT tail, min(full_name) AS full_name FROM t GROUP BY tail HAVING count(*) = 1)
         SELECT short_name, o.full_name FROM n JOIN o ON array_to_string(string_split(trim(regexp_replace({_FOLD.format('short_name')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')[-2:], ' ') = tail""",
)
def name_suffix_match(spark, sf_dir):
    """Short names that end exactly one full name."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    short = n.select(F.concat_ws(" ", "r_name", "n_name").alias("name")).distinct()
    full = short.select(F.concat(F.lit("Land "), F.col("name")).alias("name"))
    return D.match_by_suffix(short, full).toDF("short_name", "full_name")


@query("overlap_stitch", "SELECT item_id, text AS stitched FROM benchmark WHERE length(text) > 60")
def overlap_stitch(spark, sf_dir):
    """Two overlapping scans of each item put together again."""
    b = table(spark, sf_dir, "benchmark").where("length(text) > 60")
    cut, back = F.expr("int(length(text) / 2) + item_id % 7"), F.expr("20 + item_id % 10")  # uneven overlaps
    return b.select("item_id", D.stitch(F.substring("text", F.lit(1), cut), F.substring("text", cut - back + 1, F.length("text"))).alias("stitched"))


@query(
    "permission_resolution",
    """SELECT c_custkey, list_sort(list_distinct(list_filter(d || list_filter(['export', 'admin'], lambda x: (x = 'export' AND c_acctbal > 5000) OR (x = 'admin' AND c_nationkey = 0)), lambda x: NOT (x = 'export' AND c_acctbal <= 5000) AND NOT (x = 'admin' AND c_nationkey <> 0)))) AS permissions
       FROM (SELECT *, CASE WHEN c_mktsegment = 'FURNITURE' THEN ['read', 'admin'] ELSE ['read', 'export'] END AS d FROM customer)""",
)
def permission_resolution(spark, sf_dir):
    """Role defaults with per-party switches."""
    lit = lambda *xs: F.array(*map(F.lit, xs))
    defaults = F.when(F.col("c_mktsegment") == "FURNITURE", lit("read", "admin")).otherwise(lit("read", "export"))
    switches = F.create_map(F.lit("export"), F.col("c_acctbal") > 5000, F.lit("admin"), F.col("c_nationkey") == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", D.permissions(defaults, switches).alias("permissions"))


@query(
    "role_counts",
    """SELECT role, count(c_custkey) AS n FROM (VALUES ('BUILDING'), ('FURNITURE'), ('NOBODY')) AS r(role) LEFT JOIN customer ON c_mktsegment = role AND contains(lower(c_name), 'customer#') GROUP BY 1""",
)
def role_counts(spark, sf_dir):
    """Accounts of each role that match a search, roles without any included."""
    roles = spark.sql("SELECT * FROM VALUES ('BUILDING'), ('FURNITURE'), ('NOBODY') AS t(role)")
    found = table(spark, sf_dir, "customer").where(F.lower("c_name").contains("customer#")).groupBy(F.col("c_mktsegment").alias("role")).agg(F.count(F.lit(1)).alias("n"))
    return roles.join(found, "role", "left").select("role", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "host_allow_list",
    r"""SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, count(*) AS n, bool_and(url LIKE '%.org%' AND lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) = 'therwh.example.org') AS allowed FROM pages GROUP BY 1""",
)
def host_allow_list(spark, sf_dir):
    """Pages by host, and whether the host may be read."""
    p = table(spark, sf_dir, "pages").select(M.host(F.col("url")).alias("host"), M.allowed(F.col("url"), ("therwh.example.org",)).alias("ok"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("allowed"))


@query("sealed_roundtrip", "SELECT c_custkey, c_name AS name, true AS differs FROM customer")
def sealed_roundtrip(spark, sf_dir):
    """Names sealed under their key and read back."""
    key, name = "0123456789abcdef0123456789abcdef", F.col("c_custkey").cast("string")
    c = table(spark, sf_dir, "customer").withColumn("sealed", M.seal(F.col("c_name"), key, name))
    return c.select("c_custkey", M.unseal(F.col("sealed"), key, name).alias("name"), (F.col("sealed") != F.encode("c_name", "utf-8")).alias("differs"))


@query(
    "restore_merge",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_totalprice > 1000 THEN 'imported' ELSE o_orderstatus END AS state FROM orders
       UNION ALL SELECT -o_orderkey - 1, 'imported' FROM orders WHERE o_orderkey % 3 = 0 AND o_totalprice > 1000""",
)
def restore_merge(spark, sf_dir):
    """A backup merged into a store: its valid rows win, new ones are added."""
    o = table(spark, sf_dir, "orders")
    backup = o.where("o_orderkey % 3 = 0").select(F.explode(F.array(F.col("o_orderkey"), -F.col("o_orderkey") - 1)).alias("o_orderkey"), F.lit("imported").alias("state"), "o_totalprice")
    stored = o.select("o_orderkey", F.col("o_orderstatus").alias("state"), "o_totalprice")
    return D.restore(stored, backup, "o_orderkey", F.col("o_totalprice") > 1000).select("o_orderkey", "state")


@query(
    "fill_empty",
    """SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal < 0 THEN '  ' ELSE c_mktsegment END, '  '), n_name) AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def fill_empty(spark, sf_dir):
    """Blank segments filled from the party's nation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.col("c_mktsegment")).alias("segment"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("segment"))
    return D.fill_empty(c, n, "c_nationkey", ["segment"]).select("c_custkey", "segment")


@query(
    "durations_and_money",
    """SELECT p_partkey, p_size AS months, 12 * p_size AS years_as_months, replace(regexp_replace(CAST(CAST(p_size * 1.5 AS DECIMAL(20,3)) AS VARCHAR), '\\.?0+$', ''), '.', ',') || ' triệu' AS money, p_size * 1.5 AS percent FROM part WHERE p_size > 0""",
)
def durations_and_money(spark, sf_dir):
    """Terms, amounts and percents written out and read back."""
    n = F.col("p_size").cast("string")
    text = F.concat(F.lit("Tỷ lệ thương tích là "), F.replace((F.col("p_size") * 1.5).cast("string"), F.lit("."), F.lit(",")), F.lit(" % theo kết luận"))
    return table(spark, sf_dir, "part").where("p_size > 0").select(
        "p_partkey",
        M.duration_months(F.concat(F.lit("phạt "), F.floor(F.col("p_size") / 12).cast("string"), F.lit(" năm "), (F.col("p_size") % 12).cast("string"), F.lit(" tháng"))).alias("months"),
        M.duration_months(F.concat(n, F.lit(" Năm tù"))).alias("years_as_months"),
        M.money(F.col("p_size") * 1_500_000).alias("money"),
        F.get(M.percent_near(text, "thương tích|tổn thương"), 0).alias("percent"),
    )


@query(
    "age_at_date",
    "SELECT o_orderkey, CAST(date_diff('year', DATE '1970-03-15', CAST(o_orderdate AS DATE)) - CASE WHEN strftime(o_orderdate, '%m%d') < '0315' THEN 1 ELSE 0 END AS INTEGER) AS age FROM orders",
)
def age_at_date(spark, sf_dir):
    """Age on the day of each record of someone born on a fixed day."""
    return table(spark, sf_dir, "orders").select("o_orderkey", M.age_at(F.lit("1970-03-15").cast("date"), F.to_date("o_orderdate")).alias("age"))


@query(
    "unanswered_questions",
    """SELECT n_nationkey AS question FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)""",
)
def unanswered_questions(spark, sf_dir):
    """Plan questions that no answer names."""
    answered = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return table(spark, sf_dir, "nation").join(answered, "n_nationkey", "left_anti").select(F.col("n_nationkey").alias("question"))
