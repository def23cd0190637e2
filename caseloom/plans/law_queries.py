"""Queries on outlines of long texts and on rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.operators import outline, rules
from caseloom.plans.registry import query
from caseloom.session import table

#: The lines of each document as those of a book of law: every 17 lines a part, chapter, section, articles (one of
#: them with a number that doesn't rise), clauses, points and a comment. Spark and DuckDB read the same expression.
_LINE = """CASE n % 17 WHEN 0 THEN concat('Phần thứ ', CASE WHEN n < 17 THEN 'nhất' ELSE 'hai' END) WHEN 1 THEN upper(replace(left(line, 20), 'ß', 's')) WHEN 2 THEN concat('Chương ', CASE WHEN n < 34 THEN 'II' ELSE 'IV' END, CASE WHEN n % 2 = 0 THEN '' ELSE ' QUY CHUNG' END)
  WHEN 4 THEN concat('Mục 1. ', upper(replace(left(line, 15), 'ß', 's'))) WHEN 5 THEN concat('Điều ', n, '. ', line) WHEN 6 THEN concat('1. ', line) WHEN 7 THEN concat('a) ', line) WHEN 8 THEN concat('Điều ', n - 6, '. ', line) WHEN 9 THEN concat('b) ', line)
  WHEN 10 THEN concat('2. ', line) WHEN 11 THEN concat('Điều ', n, 'a quy định ', line) WHEN 12 THEN concat('Điều ', n, 'đ ', line) WHEN 13 THEN 'Bình luận' WHEN 14 THEN concat('1. ', line) WHEN 16 THEN '' ELSE line END"""


def book(spark, sf_dir) -> DataFrame:
    lines = outline.lines_of(table(spark, sf_dir, "documents")).withColumn("line", F.trim(F.regexp_replace("line", r"[\p{Zs}\p{Cc}]+", " ")))
    return lines.select("doc_id", "n", F.expr(_LINE).alias("line"))


#: read(doc_id, n, line, kind, ...): a reader that goes from line to line and remembers.
_READ = rf"""raw AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS ls FROM documents), numbered AS (SELECT doc_id, unnest(range(len(ls))) AS n, trim(regexp_replace(unnest(ls), '[\p{{Zs}}\p{{Cc}}]+', ' ', 'g')) AS line FROM raw),
  book AS (SELECT doc_id, n, {_LINE} AS line FROM numbered),
  marked AS (SELECT doc_id, n, line, trim(line) AS t, regexp_matches(line, '\p{{L}}') AND upper(line) = line AS caps,
    regexp_extract(trim(line), '^(?:Phần|PHẦN)\s+(?:thứ\s+|THỨ\s+)?(\p{{L}}+|\d+)[.:]?\s*(.*)$', ['a', 'b']) AS p, regexp_extract(trim(line), '^(?:Chương|CHƯƠNG)\s+([IVXLC]+|\d+)[.:]?\s*(.*)$', ['a', 'b']) AS c,
    regexp_extract(trim(line), '^(?:Mục|MỤC)\s+(\d+)[.:]\s*(.+)$', ['a', 'b']) AS s, regexp_extract(trim(line), '^Điều\s+(\d{{1,3}})([a-zđ]?)[.:]?\s+(.*)$', ['a', 'b', 'c']) AS d FROM book),
  caps AS (SELECT *, CASE WHEN p.a <> '' AND (p.b = '' OR (regexp_matches(p.b, '\p{{L}}') AND upper(p.b) = p.b)) AND length(t) < 120 THEN 'part' WHEN c.a <> '' AND (c.b = '' OR (regexp_matches(c.b, '\p{{L}}') AND upper(c.b) = c.b)) AND length(t) < 160 THEN 'chapter'
      WHEN s.a <> '' AND regexp_matches(s.b, '\p{{L}}') AND upper(s.b) = s.b AND length(t) < 160 THEN 'section' END AS w,
    CASE WHEN d.a <> '' AND NOT regexp_matches(d.c, '^(quy định|và|hoặc|của|này|nêu|được|có|thì|là|về|trên)([^\p{{L}}]|$)') AND length(t) < 260 AND TRY_CAST(d.a AS INTEGER) <= 426 THEN TRY_CAST(d.a AS INTEGER) * 30 + CASE d.b WHEN '' THEN 0 WHEN 'đ' THEN 29 ELSE ascii(d.b) - 96 END END AS r,
    caps AND p.a = '' AND c.a = '' AND s.a = '' AND d.a = '' AS plain FROM marked),
  walk AS (SELECT doc_id, -1::BIGINT AS n, ''::VARCHAR AS line, NULL::VARCHAR AS kind, NULL::VARCHAR AS part, NULL::VARCHAR AS chapter, NULL::VARCHAR AS section, NULL::VARCHAR AS article, NULL::INTEGER AS clause, NULL::VARCHAR AS point, NULL::VARCHAR AS pending, 0 AS top, false AS remark, false AS any_article FROM (SELECT DISTINCT doc_id FROM book)
    UNION ALL SELECT y.doc_id, y.n, y.line, kind,
      CASE WHEN kind = 'part' THEN regexp_replace(t, '\s+', ' ', 'g') WHEN kind = 'name' AND pending = 'part' THEN part || ' ' || regexp_replace(t, '\s+', ' ', 'g') ELSE part END,
      CASE WHEN kind = 'part' THEN NULL WHEN kind = 'chapter' THEN regexp_replace(t, '\s+', ' ', 'g') WHEN kind = 'name' AND pending = 'chapter' THEN chapter || ' ' || regexp_replace(t, '\s+', ' ', 'g') ELSE chapter END,
      CASE WHEN kind IN ('part', 'chapter') THEN NULL WHEN kind = 'section' THEN regexp_replace(t, '\s+', ' ', 'g') WHEN kind = 'name' AND pending = 'section' THEN section || ' ' || regexp_replace(t, '\s+', ' ', 'g') ELSE section END,
      CASE WHEN kind IN ('part', 'chapter', 'section') THEN NULL WHEN kind = 'article' THEN d.a || d.b ELSE article END,
      CASE WHEN kind IN ('article', 'part', 'chapter', 'section') THEN NULL WHEN kind = 'body' AND cl > coalesce(clause, 0) THEN cl ELSE clause END,
      CASE WHEN kind IN ('article', 'part', 'chapter', 'section') OR (kind = 'body' AND cl > coalesce(clause, 0)) THEN NULL WHEN kind = 'body' AND clause IS NOT NULL AND pt <> '' THEN pt ELSE point END,
      CASE WHEN kind IN ('part', 'chapter', 'section') THEN kind WHEN kind = 'name' OR t = '' THEN pending END,
      CASE WHEN kind = 'article' THEN r ELSE top END, CASE WHEN kind IN ('part', 'chapter', 'section', 'article') THEN false ELSE remark OR kind = 'comment head' END, any_article OR kind = 'article'
    FROM (SELECT v.doc_id, x.n, x.line, x.t, x.d, x.r, v.part, v.chapter, v.section, v.article, v.clause, v.point, v.pending, v.top, v.remark, v.any_article, TRY_CAST(regexp_extract(x.t, '^(\d{{1,2}})\.\s', 1) AS INTEGER) AS cl, regexp_extract(x.t, '^([a-zđ])\)\s', 1) AS pt,
      CASE WHEN v.pending IS NOT NULL AND plain THEN 'name' WHEN w IS NOT NULL THEN w WHEN r > v.top THEN 'article' WHEN v.article IS NULL THEN CASE WHEN v.any_article THEN 'between' ELSE 'title' END
        WHEN NOT v.remark AND regexp_matches(x.t, '^[Bb]ình luận\b.{{0,40}}$') THEN 'comment head' WHEN v.remark THEN 'comment' ELSE 'body' END AS kind
      FROM walk v JOIN caps x ON x.doc_id = v.doc_id AND x.n = v.n + 1) y),
  read AS (SELECT doc_id, n, line, kind, part, chapter, section, article, CASE WHEN kind = 'body' THEN clause END AS clause, CASE WHEN kind = 'body' THEN point END AS point FROM walk WHERE n >= 0)"""


@query("law_tree", f"WITH RECURSIVE {_READ} SELECT doc_id, n::INTEGER AS n, kind, part, chapter, section, article, clause, point FROM read")
def law_tree(spark, sf_dir):
    """Each line's kind and its place in the outline; in SQL by a reader that goes line by line."""
    return outline.outlined(book(spark, sf_dir), 426).drop("line")


@query("law_tree_roundtrip", f"WITH RECURSIVE {_READ} SELECT doc_id, count(*) AS n_lines, count(DISTINCT article) AS n_articles, md5(string_agg(line, chr(10) ORDER BY n)) AS text_md5 FROM read GROUP BY doc_id")
def law_tree_roundtrip(spark, sf_dir):
    """The text written again from its articles: the same lines as before."""
    o = outline.outlined(book(spark, sf_dir), 426)
    back = outline.rebuilt(o).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"))
    found = o.groupBy("doc_id").agg(F.count_distinct("article").alias("n_articles"))
    return back.join(found, "doc_id").select("doc_id", "n_lines", "n_articles", F.md5(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text_md5"))


# Frames of three articles: (article, clause, least and most months, life, death, value from and to).
_FRAMES = [(0, 1, 6, 36, False, False, 2e3, 50e3), (0, 2, 24, 84, False, False, 50e3, 200e3), (0, 3, 84, 180, False, False, 200e3, 500e3), (0, 4, 144, 240, True, False, 500e3, None), (1, 1, 3, 36, False, False, 10e3, 60e3), (1, 2, 36, 120, False, False, 60e3, None), (2, 1, 12, 60, False, False, None, None), (2, 2, 84, 240, True, True, None, None)]
_FRAME_NAMES = "article, clause, low, high, life, death, from_value, to_value"


def cases(spark, sf_dir) -> DataFrame:
    """Verdicts made of the order lines: article, clause, kind and length of the penalty, value, circumstances; with their frame, the
    next lighter one, and the clause that the value asks for."""
    frames = spark.createDataFrame(_FRAMES, "article int, clause int, low int, high int, life boolean, death boolean, from_value double, to_value double")
    li = table(spark, sf_dir, "lineitem")
    c = li.select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 3).cast("int").alias("article"), (F.col("l_linenumber") % 5).cast("int").alias("clause"),
        F.when(F.col("l_quantity") > 48, "life").when(F.col("l_quantity") > 46, "death").otherwise("term").alias("penalty"), (F.col("l_quantity") * 6).cast("int").alias("months"), F.col("l_extendedprice").alias("value"),
        (F.col("l_discount") * 100 + 0.5).cast("int").alias("mitigating"), (F.col("l_tax") > 0.05).alias("aggravated"), (F.col("l_returnflag") == "A").alias("suspended"), (F.col("l_returnflag") == "N").alias("below"),
        (F.col("l_suppkey") % 70 + 6).cast("int").alias("probation"), (F.col("l_linestatus") == "F").alias("attempt"), (F.col("l_suppkey") % 40 + 12).cast("int").alias("age"),
    )
    own = frames.select("article", "clause", "low", "high", "life", "death", F.lit(True).alias("framed"))
    lighter = frames.select("article", (F.col("clause") + 1).alias("clause"), F.col("low").alias("lighter_low"))
    # The frames of an article are a few rows: they go to the cases, and no case moves.
    by_value = frames.where("from_value is not null").groupBy("article").agg(F.collect_list(F.struct(F.col("clause").alias("fits"), "from_value", "to_value")).alias("__frames"))
    held = F.filter("__frames", lambda f: (f["from_value"] <= F.col("value")) & (f["to_value"].isNull() | (F.col("value") < f["to_value"])))
    out = c.join(F.broadcast(own), ["article", "clause"], "left").join(F.broadcast(lighter), ["article", "clause"], "left").join(F.broadcast(by_value), "article", "left")
    return out.withColumn("fits", F.array_max(F.transform(held, lambda f: f["fits"]))).drop("__frames")


#: (rule, level, condition, text). A term of 3 to 240 months; suspension up to 36 with a probation of 12 to 60;
#: an attempt takes three quarters, or 240 for the heaviest; from 16 to 17 years three quarters and 216, from 14 to 15 half and 144.
RULES = [
    ("is_term", "value", "penalty = 'term'", None),
    ("no_frame", "error", "framed is null", "concat('article ', article, ' has no clause ', clause)"),
    ("value_clause", "error", "framed and fits is not null and fits <> clause", "concat('the value asks for clause ', fits)"),
    ("value_heavier", "note", "value_clause and fits > clause", None),
    ("value_lighter", "note", "value_clause and fits < clause", None),
    ("value_fits", "right", "framed and fits = clause", None),
    ("term_limits", "error", "framed and is_term and (months < 3 or months > 240)", None),
    ("above_frame", "error", "framed and is_term and months > high and not heaviest", "concat(months, ' months are over ', high)"),
    ("under", "value", "framed and is_term and not coalesce(above_frame, false) and months < low", None),
    ("below_without_leave", "error", "under and not below", "concat(months, ' months are under ', low)"),
    ("below_too_few", "error", "under and below and mitigating < 2", None),
    ("below_next_frame", "warning", "under and below and mitigating >= 2 and lighter_low is not null and months < lighter_low", None),
    ("below_right", "right", "under and below and not below_too_few and not below_next_frame", None),
    ("in_frame", "right", "framed and is_term and not above_frame and not under", None),
    ("life_not_provided", "error", "framed and penalty = 'life' and not life", None),
    ("death_not_provided", "error", "framed and penalty = 'death' and not death", None),
    ("suspended_too_long", "error", "suspended and is_term and months > 36", None),
    ("probation_range", "error", "suspended and (probation < 12 or probation > 60)", None),
    ("suspended_aggravated", "warning", "suspended and aggravated", None),
    ("may_be_suspended", "advice", "not suspended and is_term and months <= 36 and mitigating >= 2 and not aggravated", None),
    ("grave", "warning", "(above_frame or below_without_leave or value_heavier) and no_frame = false", "'to be reviewed first'"),
    ("heaviest", "value", "coalesce(life or death, false)", None),
    ("high_attempt", "value", "case when not attempt then high when heaviest then 240 else cast(floor(high * 0.75) as int) end", None),
    ("open_end", "value", "heaviest and not attempt", None),
    ("young_share", "value", "case when age between 16 and 17 then 0.75 when age between 14 and 15 then 0.5 end", None),
    ("young_most", "value", "case when age between 16 and 17 then 216 when age between 14 and 15 then 144 end", None),
    ("range_high", "value", "case when young_most is null then high_attempt when open_end then least(coalesce(high_attempt, young_most), young_most) else least(cast(floor(high_attempt * young_share) as int), young_most) end", None),
    ("range_low", "value", "least(low, range_high)", None),
    ("range_life", "value", "coalesce(life, false) and not attempt and young_most is null", None),
    ("range_death", "value", "coalesce(death, false) and not attempt and young_most is null", None),
    ("range_suspension", "value", "not range_life and not range_death and coalesce(case when mitigating >= 2 and lighter_low is not null then lighter_low else range_low end <= 36, false)", None),
]


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, level string, condition string, text string")


_CASES = f"""f({_FRAME_NAMES}) AS (VALUES {', '.join('(' + ', '.join('NULL' if v is None else str(v) for v in r) + ')' for r in _FRAMES)}),
  v AS (SELECT l_orderkey AS case_id, l_linenumber AS n, (l_partkey % 3)::INTEGER AS article, (l_linenumber % 5)::INTEGER AS clause, CASE WHEN l_quantity > 48 THEN 'life' WHEN l_quantity > 46 THEN 'death' ELSE 'term' END AS penalty, (l_quantity * 6)::INTEGER AS months, l_extendedprice AS value,
    floor(l_discount * 100 + 0.5)::INTEGER AS mitigating, l_tax > 0.05 AS aggravated, l_returnflag = 'A' AS suspended, l_returnflag = 'N' AS below, (l_suppkey % 70 + 6)::INTEGER AS probation, l_linestatus = 'F' AS attempt, (l_suppkey % 40 + 12)::INTEGER AS age FROM lineitem),
  c AS (SELECT v.*, f.low, f.high, f.life, f.death, f.article IS NOT NULL AS framed, (SELECT g.low FROM f g WHERE g.article = v.article AND g.clause = v.clause - 1) AS lighter_low,
    (SELECT max(g.clause) FROM f g WHERE g.article = v.article AND g.from_value IS NOT NULL AND v.value >= g.from_value AND (g.to_value IS NULL OR v.value < g.to_value)) AS fits FROM v LEFT JOIN f ON f.article = v.article AND f.clause = v.clause)"""


@query(
    "case_findings",
    f"""WITH {_CASES}, j AS (SELECT *, penalty = 'term' AS term, framed AND penalty = 'term' AND months > high AND NOT life AND NOT death AS over, coalesce(framed AND penalty = 'term' AND NOT (months > high AND NOT life AND NOT death) AND months < low, false) AS under FROM c),
        k AS (SELECT *, coalesce(over, false) AS o FROM j)
        SELECT case_id, n, r.rule, r.level, r.text FROM k, LATERAL (SELECT unnest([
          CASE WHEN NOT framed THEN {{'rule': 'no_frame', 'level': 'error', 'text': 'article ' || article || ' has no clause ' || clause}} END,
          CASE WHEN framed AND fits <> clause THEN {{'rule': 'value_clause', 'level': 'error', 'text': 'the value asks for clause ' || fits}} END,
          CASE WHEN framed AND fits > clause THEN {{'rule': 'value_heavier', 'level': 'note', 'text': NULL}} END, CASE WHEN framed AND fits < clause THEN {{'rule': 'value_lighter', 'level': 'note', 'text': NULL}} END,
          CASE WHEN framed AND fits = clause THEN {{'rule': 'value_fits', 'level': 'right', 'text': NULL}} END,
          CASE WHEN framed AND term AND (months < 3 OR months > 240) THEN {{'rule': 'term_limits', 'level': 'error', 'text': NULL}} END,
          CASE WHEN o THEN {{'rule': 'above_frame', 'level': 'error', 'text': months || ' months are over ' || high}} END,
          CASE WHEN under AND NOT below THEN {{'rule': 'below_without_leave', 'level': 'error', 'text': months || ' months are under ' || low}} END,
          CASE WHEN under AND below AND mitigating < 2 THEN {{'rule': 'below_too_few', 'level': 'error', 'text': NULL}} END,
          CASE WHEN under AND below AND mitigating >= 2 AND months < lighter_low THEN {{'rule': 'below_next_frame', 'level': 'warning', 'text': NULL}} END,
          CASE WHEN under AND below AND mitigating >= 2 AND NOT coalesce(months < lighter_low, false) THEN {{'rule': 'below_right', 'level': 'right', 'text': NULL}} END,
          CASE WHEN framed AND term AND NOT o AND NOT under THEN {{'rule': 'in_frame', 'level': 'right', 'text': NULL}} END,
          CASE WHEN framed AND penalty = 'life' AND NOT life THEN {{'rule': 'life_not_provided', 'level': 'error', 'text': NULL}} END, CASE WHEN framed AND penalty = 'death' AND NOT death THEN {{'rule': 'death_not_provided', 'level': 'error', 'text': NULL}} END,
          CASE WHEN suspended AND term AND months > 36 THEN {{'rule': 'suspended_too_long', 'level': 'error', 'text': NULL}} END, CASE WHEN suspended AND probation NOT BETWEEN 12 AND 60 THEN {{'rule': 'probation_range', 'level': 'error', 'text': NULL}} END,
          CASE WHEN suspended AND aggravated THEN {{'rule': 'suspended_aggravated', 'level': 'warning', 'text': NULL}} END,
          CASE WHEN NOT suspended AND term AND months <= 36 AND mitigating >= 2 AND NOT aggravated THEN {{'rule': 'may_be_suspended', 'level': 'advice', 'text': NULL}} END,
          CASE WHEN framed AND (o OR (under AND NOT below) OR coalesce(fits > clause, false)) THEN {{'rule': 'grave', 'level': 'warning', 'text': 'to be reviewed first'}} END]) AS r) WHERE r IS NOT NULL""",
)
def case_findings(spark, sf_dir):
    """What a table of rules finds wrong, doubtful or right in each verdict."""
    return rules.findings(cases(spark, sf_dir), rule_table(spark), ["case_id", "n"])


@query(
    "legal_range",
    f"""WITH {_CASES}, a AS (SELECT *, life OR death AS top, CASE WHEN NOT attempt THEN high WHEN life OR death THEN 240 ELSE floor(high * 0.75)::INTEGER END AS m, CASE WHEN age IN (16, 17) THEN 0.75 WHEN age IN (14, 15) THEN 0.5 END AS part, CASE WHEN age IN (16, 17) THEN 216 WHEN age IN (14, 15) THEN 144 END AS lim FROM c),
        b AS (SELECT *, CASE WHEN lim IS NULL THEN m WHEN NOT framed OR (top AND NOT attempt) THEN least(m, lim) ELSE least(floor(m * part)::INTEGER, lim) END AS hi FROM a)
        SELECT case_id, n, CASE WHEN framed THEN least(low, hi) END AS low, CASE WHEN framed THEN hi END AS high, coalesce(life AND NOT attempt AND lim IS NULL, false) AS life, coalesce(death AND NOT attempt AND lim IS NULL, false) AS death,
          NOT coalesce(life AND NOT attempt AND lim IS NULL, false) AND NOT coalesce(death AND NOT attempt AND lim IS NULL, false) AND coalesce(CASE WHEN mitigating >= 2 AND lighter_low IS NOT NULL THEN lighter_low ELSE CASE WHEN framed THEN least(low, hi) END END <= 36, false) AS suspension FROM b""",
)
def legal_range(spark, sf_dir):
    """The range of penalties that the law allows: the frame, less for attempts and for the young."""
    r = rules.evaluated(cases(spark, sf_dir), rule_table(spark))
    shown = {"range_low": "low", "range_high": "high", "range_life": "life", "range_death": "death", "range_suspension": "suspension"}
    framed = lambda c: F.when(F.col("framed"), F.col(c)) if c in ("range_low", "range_high") else F.col(c)
    return r.select("case_id", "n", *[framed(c).alias(name) for c, name in shown.items()])


@query(
    "statute_ranges",
    """SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN a WHEN 2 THEN a WHEN 3 THEN a END AS low, CASE k WHEN 0 THEN b WHEN 1 THEN b WHEN 2 THEN a WHEN 3 THEN b END AS high, k = 3 AS life, k = 3 AS death,
         CASE WHEN k IN (1, 4) THEN 36 END AS reform, CASE WHEN k = 4 THEN l_partkey * 1000000.0 END AS fine_low, CASE WHEN k = 4 THEN (l_partkey + 20) * 1000000.0 END AS fine_high, v AS value_from, CASE WHEN k <> 3 THEN v * 5 END AS value_to
       FROM (SELECT *, l_linenumber % 5 AS k, (l_quantity::INTEGER % 9 + 1) * CASE WHEN l_tax > 0.04 THEN 12 ELSE 1 END AS a, (l_quantity::INTEGER % 9 + 11) * 12 AS b, (floor(l_extendedprice)::BIGINT + 20000) AS v FROM lineitem)""",
)
def statute_ranges(spark, sf_dir):
    """Penalties and ranges of value read from clauses that are written in words of several forms."""
    from caseloom.functions import statutes as L

    q = F.col("l_quantity").cast("int") % 9
    li = table(spark, sf_dir, "lineitem").withColumns({"a": F.concat(F.lpad((q + 1).cast("string"), 2, "0"), F.when(F.col("l_tax") > 0.04, " năm").otherwise(" tháng")), "b": F.concat((q + 11).cast("string"), F.lit(" năm")), "v": F.floor("l_extendedprice") + 20000, "k": F.col("l_linenumber") % 5})
    money = lambda c: F.translate(F.format_number(c, 0), ",", ".")
    p = F.col("l_partkey").cast("string")
    said = (
        F.when(F.col("k") == 0, F.concat(F.lit("thì bị phạt tù từ "), "a", F.lit(" đến "), "b", F.lit(".")))
        .when(F.col("k") == 1, F.concat(F.lit("thì bị phạt cải tạo không giam giữ đến 03 năm hoặc PHẠT TÙ  đến "), "b"))
        .when(F.col("k") == 2, F.concat(F.lit("thì bị phạt tù "), "a", F.lit("; đến 9 năm là mức khác")))
        .when(F.col("k") == 3, F.concat(F.lit("thì bị phạt tù từ "), "a", F.lit(" đến "), "b", F.lit(", tù chung thân hoặc tử hình")))
        .otherwise(F.concat(F.lit("thì bị phạt tiền từ "), p, F.lit(" triệu đồng đến "), (F.col("l_partkey") + 20).cast("string"), F.lit(" triệu đồng, cải tạo không giam giữ từ 01 năm đến 03 năm")))
    )
    of = F.concat(F.lit("Tài sản trị giá từ "), money(F.col("v")), F.when(F.col("k") == 3, " đồng trở lên; ").otherwise(F.concat(F.lit(" đồng đến dưới "), money(F.col("v") * 5), F.lit(" đồng, "))))
    r = li.select("l_orderkey", "l_linenumber", L.clause(F.concat(of, said)).alias("c")).select("l_orderkey", "l_linenumber", "c.penalty", F.get("c.ranges", 0).alias("r"))
    return r.select("l_orderkey", "l_linenumber", "penalty.*", F.col("r.from").alias("value_from"), F.col("r.to").alias("value_to"))


@query(
    "number_words",
    """WITH n AS (SELECT DISTINCT o_custkey * o_orderkey * 1000003 % 999999999999 AS n FROM orders), g AS (SELECT n, unnest(range(4)) AS k FROM n), h AS (SELECT n, k, (n // CAST(pow(1000, k) AS BIGINT)) % 1000 AS v, (SELECT max(j) FROM range(4) t(j) WHERE n >= pow(1000, j)) AS top FROM g),
         w AS (SELECT n, k, top, v, v // 100 AS a, v // 10 % 10 AS b, v % 10 AS c, ['không', 'một', 'hai', 'ba', 'bốn', 'năm', 'sáu', 'bảy', 'tám', 'chín'] AS d FROM h WHERE v > 0)
       SELECT n, CASE WHEN n = 0 THEN 'không' ELSE string_agg(concat_ws(' ', CASE WHEN a > 0 OR k < top THEN d[a + 1] || ' trăm' END, CASE WHEN b = 0 AND c > 0 AND (a > 0 OR k < top) THEN 'linh' WHEN b = 1 THEN 'mười' WHEN b > 1 THEN d[b + 1] || ' mươi' END,
         CASE WHEN c = 0 THEN NULL WHEN c = 1 AND b > 1 THEN 'mốt' WHEN c = 5 AND b > 0 THEN 'lăm' WHEN c = 4 AND b > 1 THEN 'tư' ELSE d[c + 1] END, [NULL, 'nghìn', 'triệu', 'tỷ'][k + 1]), ' ' ORDER BY k DESC) END AS words, n AS back
       FROM n LEFT JOIN w USING (n) GROUP BY n""",
)
def number_words(spark, sf_dir):
    """Numbers up to twelve digits in words, and the words read back."""
    from caseloom.functions import numbers as N

    n = table(spark, sf_dir, "orders").select((F.col("o_custkey") * F.col("o_orderkey") * 1000003 % 999999999999).alias("n")).distinct()
    return n.select("n", N.number_words(F.col("n").cast("string")).alias("words")).select("n", "words", N.words_number(F.col("words")).cast("long").alias("back"))


def _answers(spark, sf_dir):
    """Answers of each order's lines about money given and taken, and their questions."""
    from caseloom.operators import statements as St

    verb = F.element_at(F.array(*map(F.lit, St.VERBS)), (F.col("l_suppkey") % 7 + 1).cast("int"))
    sum_ = F.concat((F.col("l_partkey") % 3 + 1).cast("string"), F.lit(" triệu đồng"))
    k = F.col("l_linenumber") % 3
    said = F.when(k == 0, F.concat(F.lit("Tôi đã "), verb, F.lit(" "), sum_, F.lit("; còn lại thì không nhớ"))).when(k == 1, F.concat(F.lit("Có việc đó. Tôi "), verb, F.lit(" "), sum_)).otherwise("Tôi không hề biết")
    asked = F.concat(F.lit("Anh kể về "), F.when(F.col("l_partkey") % 2 == 0, "việc đồng tiền").otherwise("chuyến hàng"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("n"), asked.alias("question"), said.alias("answer"))


_ANSWERS = """x AS (SELECT l_orderkey AS case_id, l_linenumber * 100000 + l_partkey AS n, l_linenumber % 3 AS k, l_partkey % 2 = 0 AS about, ['nhận', 'đưa', 'chuyển', 'chi', 'trả', 'vay', 'cho'][(l_suppkey % 7 + 1)::INTEGER] AS verb, (l_partkey % 3 + 1) * 1000000.0 AS s FROM lineitem)"""


@query(
    "differing_sums",
    f"WITH {_ANSWERS} SELECT case_id, verb, count(DISTINCT s) AS n_sums, string_agg(DISTINCT s::BIGINT::VARCHAR, ',' ORDER BY s::BIGINT::VARCHAR) AS sums, min(n) AS first_at FROM x WHERE k < 2 GROUP BY 1, 2 HAVING count(DISTINCT s) > 1",
)
def differing_sums(spark, sf_dir):
    """Verbs with which the answers of a case name different sums."""
    from caseloom.operators import statements as St

    d = St.differing_sums(_answers(spark, sf_dir))
    return d.select("case_id", "verb", "n_sums", F.array_join(F.transform("sums", lambda s: s.cast("long").cast("string")), ",").alias("sums"), "first_at")


@query(
    "late_denials",
    f"WITH {_ANSWERS} SELECT d.case_id, d.n, min(a.n) AS admitted_at FROM x d JOIN x a ON a.case_id = d.case_id AND a.n < d.n AND a.k = 1 AND d.about WHERE d.k = 2 GROUP BY 1, 2",
)
def late_denials(spark, sf_dir):
    """Answers that deny what an earlier one of the same case admits."""
    from caseloom.operators import statements as St

    return St.late_denials(_answers(spark, sf_dir), "case_id")


@query(
    "book_search",
    f"""WITH RECURSIVE {_READ}, own AS (SELECT doc_id, n, article, kind, lower(CASE WHEN kind = 'article' THEN regexp_replace(line, '^\\s*Điều\\s+\\d{{1,3}}[a-zđ]?[.:]?\\s+', '') ELSE line END) AS l FROM read WHERE article IS NOT NULL AND kind IN ('article', 'body', 'comment')),
        g AS (SELECT *, contains(l, 'the of') AS whole FROM own WHERE contains(l, 'the of') OR (regexp_matches(l, '(^|[^a-z0-9])the') AND regexp_matches(l, '(^|[^a-z0-9])of'))),
        h AS (SELECT doc_id, article, n, kind, CASE kind WHEN 'article' THEN CASE WHEN whole THEN 100 ELSE 80 END WHEN 'body' THEN CASE WHEN whole THEN 50 ELSE 40 END ELSE CASE WHEN whole THEN 30 ELSE 20 END END AS w FROM g),
        f AS (SELECT doc_id, article, max(w) + least(count(*) FILTER (kind <> 'article'), 20) AS score, greatest(count(*) FILTER (kind <> 'article'), 1) AS hits, arg_max(kind, (kind = 'article', w, -n)) AS kind FROM h GROUP BY 1, 2)
        SELECT doc_id, f.article, CASE kind WHEN 'article' THEN 'name' WHEN 'body' THEN 'text' ELSE 'comment' END AS place, score, hits, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, (SELECT min(n) FROM own o WHERE o.doc_id = f.doc_id AND o.article = f.article)) AS rank FROM f""",
)
def book_search(spark, sf_dir):
    """Articles that a search for two words finds, best first."""
    from caseloom.operators import search

    return search.search_book(outline.outlined(book(spark, sf_dir), 426), "THE  of")
