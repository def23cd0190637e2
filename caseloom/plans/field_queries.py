"""Queries on kinds of documents and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import fields as L
from caseloom.plans.registry import query
from caseloom.session import table

KINDS = [("judgment", 1, r"(?m)^BẢN ÁN\b"), ("charge", 2, r"(?m)^CÁO TRẠNG\b"), ("decision", 3, r"(?m)^QUYẾT ĐỊNH\b")]
FIELDS = [
    ("number", 1, "text", r"(?m)^Số\s*:\s*([^\n;]+)"), ("number", 2, "text", r"[Bb]ản án số\s+([^\s,;)]+)"), ("day", 1, "date", r"ngày\s+(\d{1,2} tháng \d{1,2} năm \d{4})"), ("day", 2, "date", r"ngày\s+(\d{1,2}/\d{1,2}/\d{4})"),
    ("name", 1, "text", r"Họ (?:và )?tên\s*:\s*([^\t;,\n]+)"), ("trade", 1, "text", r"Nghề nghiệp\s*:\s*([^;\n]+)"), ("phone", 1, "number", r"Điện thoại[^:\n]*:\s*([0-9 .]{6,14})"), ("closed", 1, "check", r"(xét xử kín)"),
]


def papers(spark, sf_dir):
    """A paper for each order: of several kinds, with its number, day and person written in several ways."""
    k = F.col("o_orderkey") % 5
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day, num = F.date_format("o_orderdate", "d/M/yyyy"), F.concat(F.col("o_orderkey").cast("string"), F.lit("/HS"))
    title = F.when(k == 0, "Bản án").when(k == 1, "Cáo trạng").when(k == 2, "Quyết định").when(k == 3, "Thông báo").otherwise("x\nBẢN ÁN")
    head = F.concat(title, F.when(k == 3, F.concat(F.lit("\ntheo bản án số "), num, F.lit(", đã gửi"))).otherwise(F.concat(F.lit("\nSố : "), num, F.lit(" ; lưu"))))
    when = F.when(k < 2, F.concat(F.lit("\nngày "), F.date_format("o_orderdate", "d"), F.lit(" tháng "), F.date_format("o_orderdate", "M"), F.lit(" năm "), F.date_format("o_orderdate", "yyyy"))).otherwise(F.concat(F.lit("\nngày "), day))
    who = F.concat(F.lit("\nHọ và tên:  "), "c_name", F.lit(".; Nghề nghiệp: "), F.lower("c_mktsegment"), F.when(k == 4, " ,\nĐiện thoại nhà: 090 12.345").otherwise("\n"), F.when(k == 2, "\nxét xử kín").otherwise(""))
    return o.select("o_custkey", "o_orderkey", F.concat(head, when, who).alias("text"))


_PAPERS = """p AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 AS k, o_orderdate::DATE::VARCHAR AS day, c_name, lower(c_mktsegment) AS trade FROM orders JOIN customer ON c_custkey = o_custkey),
  x AS (SELECT o_custkey, o_orderkey, k, CASE k WHEN 1 THEN 'charge' WHEN 2 THEN 'decision' WHEN 3 THEN 'other' ELSE 'judgment' END AS kind, unnest(['number', 'day', 'name', 'trade', 'phone', 'closed']) AS field,
    unnest([o_orderkey || '/HS', day, c_name, trade, CASE WHEN k = 4 THEN '09012345' END, CASE WHEN k = 2 THEN 'yes' END]) AS value FROM p)"""


@query("document_fields", f"WITH {_PAPERS} SELECT o_orderkey, kind, field, value FROM x WHERE value IS NOT NULL")
def document_fields(spark, sf_dir):
    """The kind of each paper and the fields that are read from it."""
    kinds = spark.createDataFrame(KINDS, "kind string, place int, pattern string")
    rules = spark.createDataFrame(FIELDS, "field string, place int, form string, pattern string")
    return L.fields(L.classified(papers(spark, sf_dir), kinds), rules, ["o_orderkey", "kind"]).drop("quote")


@query(
    "case_fields",
    f"""WITH {_PAPERS}, r AS (SELECT o_custkey, field, value, min((CASE WHEN field = 'number' AND kind = 'judgment' THEN 1 WHEN field = 'number' AND kind = 'charge' THEN 2 WHEN field = 'day' AND kind = 'decision' THEN 1 ELSE 1000 END, o_orderkey)) AS at, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY 1, 2, 3)
        SELECT o_custkey, field, value, at[2] AS o_orderkey, n AS n_docs, count(*) OVER (PARTITION BY o_custkey, field) - 1 AS others FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey, field ORDER BY at, value) = 1""".replace(" AS at,", " AS place,").replace("at[2]", "place[2]").replace("ORDER BY at,", "ORDER BY place,"),
)
def case_fields(spark, sf_dir):
    """Each case's fields, from the kind of paper that is trusted most."""
    kinds = spark.createDataFrame(KINDS, "kind string, place int, pattern string")
    rules = spark.createDataFrame(FIELDS, "field string, place int, form string, pattern string")
    trust = spark.createDataFrame([("number", "judgment", 1), ("number", "charge", 2), ("day", "decision", 1)], "field string, kind string, rank int")
    found = L.fields(L.classified(papers(spark, sf_dir), kinds), rules, ["o_custkey", "o_orderkey", "kind"])
    return L.case_fields(found, trust, "o_custkey", "o_orderkey")
