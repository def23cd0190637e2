"""Rule tables, outlines, numbers in words and statutes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from caseloom.functions import extract as X, measures, numbers as N, statutes as L
from caseloom.operators import deadlines, documents, fields, flows, outline, relational, retrieval, rules, search, statements

RULES = "rule string, level string, condition string, text string"


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_rules_use_each_other_in_any_order(spark):
    rows = [("late", "error", "days > limit_days", "concat('late by ', days - limit_days)"), ("limit_days", "value", "case when minor then 10 else 5 end", None), ("grave", "warning", "late and not excused", None), ("excused", "note", "reason = 'late' or reason is null", None)]
    facts = spark.createDataFrame([(1, 7, False, "x"), (2, 7, True, "x"), (3, 12, True, "late"), (4, None, None, None)], "id long, days int, minor boolean, reason string")
    for order in (rows, rows[::-1]):
        got = rules.findings(facts, spark.createDataFrame(order, RULES), ["id"]).collect()
        assert sorted(tuple(r) for r in got if r.rule == "late") == [(1, "late", "error", "late by 2"), (3, "late", "error", "late by 2")]
        assert sorted((r.id, r.rule) for r in got if r.rule != "late") == [(1, "grave"), (3, "excused"), (4, "excused")]
    assert [len(x) for x in rules.layers(rows)] == [2, 1, 1]


def test_bad_rule_tables(spark):
    facts = spark.createDataFrame([(1,)], "id long")
    table = lambda *rows: spark.createDataFrame(list(rows), RULES)
    with pytest.raises(ValueError, match="circle"):
        rules.evaluated(facts, table(("a", "error", "b", None), ("b", "error", "not a", None)))
    with pytest.raises(ValueError, match="one name"):
        rules.evaluated(facts, table(("a", "error", "true", None), ("A", "error", "true", None)))
    with pytest.raises(ValueError, match="named as columns"):
        rules.evaluated(facts, table(("id", "error", "true", None)))
    assert rules.findings(facts, table(("v", "value", "id + 1", None)), ["id"]).collect() == []
    assert rules.evaluated(facts, table(("v", "value", "id + 1", None), ("w", "value", "v * 2", None))).first().w == 4


BOOK = """Nhan đề
PHẦN THỨ NHẤT
NHỮNG QUY ĐỊNH CHUNG

TIẾP THEO
Chương I
Điều 1. Nhiệm vụ
1. Khoản một
a) Điểm a
b) Điểm b
2. Khoản hai
nối tiếp
1. Không phải khoản
Điều 170 quy định về tội cướp
Bình luận
1. Lời bàn
Điều 2a. Cơ sở
Điều 1. Lùi lại
Chương II
MỤC KHÔNG SỐ
ngoài điều
Mục 1. CÁC TỘI
Điều 3. Ba
Điều 999. Quá lớn"""


def test_outline(spark):
    docs = spark.createDataFrame([(1, BOOK), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    rows = outline.outlined(outline.lines_of(docs)).where("doc_id = 1").orderBy("n").collect()
    kinds = [r.kind for r in rows]
    assert kinds == ["title", "part", "name", "title", "name", "chapter", "article", "body", "body", "body", "body", "body", "body", "body", "comment head", "comment", "article", "body", "chapter", "name", "between", "section", "article", "body"]
    assert rows[6].part == "PHẦN THỨ NHẤT NHỮNG QUY ĐỊNH CHUNG TIẾP THEO" and rows[6].chapter == "Chương I" and rows[6].section is None
    assert [(r.article, r.clause, r.point) for r in rows[6:14]] == [("1", None, None), ("1", 1, None), ("1", 1, "a"), ("1", 1, "b"), ("1", 2, None), ("1", 2, None), ("1", 2, None), ("1", 2, None)]
    assert [r.article for r in rows[14:]] == ["1", "1", "2a", "2a", None, None, None, None, "3", "3"]
    assert rows[22].chapter == "Chương II MỤC KHÔNG SỐ" and rows[22].section == "Mục 1. CÁC TỘI"
    o = outline.outlined(outline.lines_of(docs))
    assert sorted(map(tuple, outline.rebuilt(o).collect())) == sorted(map(tuple, outline.lines_of(docs).collect()))
    assert outline.outlined(outline.lines_of(docs.where("false"))).collect() == []


def test_numbers_in_words(spark):
    rnd = random.Random(1)
    ns = [0, 1, 4, 5, 10, 11, 14, 15, 20, 21, 24, 25, 100, 101, 105, 110, 1000, 1001, 1_000_000, 10**9, 10**9 + 1, 1_005_014, 21 * 10**9 + 4000, 10**12 + 5, 3 * 10**15] + [rnd.randint(0, 10 ** rnd.randint(1, 17)) for _ in range(300)]
    rows = spark.createDataFrame([(n, str(n)) for n in ns], "n long, s string").select("n", N.number_words(F.col("s")).alias("w")).withColumn("back", N.words_number(F.col("w"))).collect()
    assert all(r.n == r.back for r in rows), [r for r in rows if r.n != r.back][:3]
    said = {r.n: r.w for r in rows}
    assert said[1_005_014] == "một triệu không trăm linh năm nghìn không trăm mười bốn" and said[21] == "hai mươi mốt" and said[15] == "mười lăm" and said[24] == "hai mươi tư"
    assert said[10**12 + 5] == "một nghìn tỷ không trăm linh năm"
    forms = {"1.234,5": "một nghìn hai trăm ba mươi tư phẩy năm", "-12": "âm mười hai", "1,234,567.05": "một triệu hai trăm ba mươi tư nghìn năm trăm sáu mươi bảy phẩy không năm", "1.000": "một nghìn", "1.5": "một phẩy năm", "12,75": "mười hai phẩy bảy mươi lăm", "1.2.3": None, "x": None, "": None, None: None, "007": "bảy", "-0": "không", "3 000 đ": "ba nghìn", "0,125": "một trăm hai mươi lăm"}
    got = spark.createDataFrame([(k, v) for k, v in enumerate(forms)], "k int, s string").select("k", N.number_words(F.col("s")).alias("w"), N.money_words(F.col("s")).alias("m")).orderBy("k").collect()
    assert [r.w for r in got] == list(forms.values())
    assert got[3].m == "Một nghìn đồng chẵn." and got[4].m == "Một phẩy năm đồng."
    assert one(spark, N.words_number(F.lit("hai mươi what"))) is None


def test_statutes(spark):
    p = lambda s: tuple(one(spark, L.penalty(F.lit(s))))
    assert p("thì bị phạt tù từ 02 năm đến 07 năm:") == (24, 84, False, False, None, None, None)
    assert p("phạt cải tạo không giam giữ đến 03 năm hoặc phạt tù từ 06 tháng đến 03 năm") == (6, 36, False, False, 36, None, None)
    assert p("phạt tù 20 năm, tù chung thân hoặc tử hình") == (240, 240, True, True, None, None, None)
    assert p("phạt tù đến 5 năm; phạt tiền từ 10.000.000 đồng đến 1,5 tỷ đồng") == (None, 60, False, False, None, 1e7, 1.5e9)
    assert p("không có gì") == (None, None, False, False, None, None, None)
    r = one(spark, L.value_ranges(F.lit("từ 2.000.000 đồng đến dưới 50.000.000 đồng hoặc 500.000.000 đồng  trở lên, 12 đồng trở lên")))
    assert [tuple(x) for x in r] == [(2_000_000, 50_000_000), (500_000_000, None)]


def test_amounts_by_tokens(spark):
    got = [float(x) for x in one(spark, X.amounts(F.lit("1,200 triệu; 1.200 triệu; 1.200.000 đồng, 2,5 tỷ và 3.5 triệu, 7.000 cái, 90 đồng, 12 triệuphú")))]
    assert got == [1_200_000, 1_200_000_000, 1_200_000, 2_500_000_000, 3_500_000]
    assert [one(spark, measures.duration_months(F.lit(s))) for s in ("2 nam 3 thang", "2 năm 3 tháng", "18 tháng", "hai năm")] == [27, 27, 18, None]


def test_gaps_by_known_sums(spark):
    edges = spark.createDataFrame([("a", "b", "m", 10.0, 1, "a"), ("a", "b", "m", 10.0, 2, "b"), ("b", "c", "m", 4.0, 3, "b"), ("c", "d", "m", None, 4, None)], "src string, dst string, kind string, amount double, at int, said_by string")
    merged = flows.merge_edges(edges)
    drawn = spark.createDataFrame([("a", 3.0), ("e", 5.0)], "party string, amount double")
    got = sorted((r.party or "", r.gap, r.amount) for r in flows.gaps(merged, drawn).collect())
    assert got == [("", "one-sided", 2.0), ("a", "no source", 7.0), ("b", "unspent", 6.0), ("c", "unknown", 1.0), ("d", "unknown", 1.0), ("e", "unspent", 5.0)]
    edits = spark.createDataFrame([("a", "b", "m", 10.0, "reverse"), ("b", "c", "m", 4.0, "kind:order"), ("c", "d", "m", None, "drop")], "src string, dst string, kind string, amount double, action string")
    assert sorted((r.src, r.dst, r.kind, r.confirmed) for r in flows.edited_edges(merged, edits).collect()) == [("b", "a", "m", "both"), ("b", "c", "order", "payer")]
    assert sorted((r.party, r.role, r.gaps) for r in flows.profiles(merged, drawn).collect())[:2] == [("a", "source", "no source"), ("b", "middle", "unspent")]


def test_restore_takes_the_last_of_a_key(spark):
    old = spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (1, "z", 2), (3, "bad", 9), (None, "n", 1)], "k int, v string, at int")
    got = documents.restore(old, new, "k", F.col("v") != "bad", F.col("at"))
    assert sorted(((r.k, r.v) for r in got.collect()), key=str) == [(1, "y"), (2, "old"), (None, "n")]


def test_folds_over_long_groups(spark):
    rnd = random.Random(6)
    rows = [(g, k, rnd.randint(1, 50)) for g in range(3) for k in range(2000 if g == 0 else 20)]
    df = spark.createDataFrame(rows, "g int, k int, q int")
    want = []
    for g in range(3):
        used = 0
        for _, k, q in sorted(r for r in rows if r[0] == g):
            if used + q <= 700:
                used += q
                want.append((g, k))
    assert sorted((r.g, r.k) for r in relational.budgeted(df, "g", ["k"], "q", 700).collect()) == sorted(want)


def test_chunks_and_context(spark):
    docs = spark.createDataFrame([(1, "a" * 500 + "\n\n " + "b" * 399 + " \n" + "c" * 10 + "\n" + "d" * 2000), (2, None), (3, " \n "), (4, "x\ny")], "doc_id long, text string")
    got = [(r.doc_id, r.chunk_no, len(r.chunk), r.chunk[:1]) for r in retrieval.pack_chunks(docs).orderBy("doc_id", "chunk_no").collect()]
    assert got == [(1, 0, 900, "a"), (1, 1, 10, "c"), (1, 2, 900, "d"), (1, 3, 900, "d"), (1, 4, 200, "d"), (4, 0, 3, "x")]
    hits = spark.createDataFrame([(7, 1, "n", 0, "x" * 30), (7, 2, "n", 4, "y" * 100), (7, 3, "m", 1, "z")], "item_id long, rank int, name string, chunk_no int, chunk string")
    c = retrieval.context(hits, most=70).first()
    assert c.n_used == 2 and c.context == "[1] (n - 1)\n" + "x" * 30 + "\n\n[3] (m - 2)\nz"


def test_statements(spark):
    rows = [(1, 1, "Ai nhận tiền của công ty?", "Tôi có nhận 5 triệu đồng. Đưa 2 triệu; cho 2.000.000 đồng"), (1, 2, "x", "nhận 7 triệu"), (1, 3, "Việc nhận TIỀN công ty?", "Tôi không hề biết"), (1, 4, "công", "chưa từng"), (2, 1, "tiền công ty", "không biết"), (2, 2, "?", "có nhận công ty"), (3, 1, None, None)]
    df = spark.createDataFrame(rows, "case_id int, n int, question string, answer string")
    got = [(r.case_id, r.verb, [float(x) for x in r.sums], r.first_at) for r in statements.differing_sums(df).collect()]
    assert got == [(1, "nhận", [5e6, 7e6], 1)]
    more = df.unionByName(spark.createDataFrame([(4, 1, "", "Đã mua hàng hóa ở công trường"), (4, 2, "chuyến hàng hàng hóa", "không có việc đó"), (4, 3, "hàn", "không biết")], df.schema))
    assert [(r.case_id, r.n, r.admitted_at) for r in statements.late_denials(more, "case_id").orderBy("case_id").collect()] == [(1, 3, 1), (4, 2, 1)]


def test_totals_over_slices_of_time(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), rnd.randint(0, 500), rnd.randint(1, 9)) for _ in range(400)] + [("a", None, 1)]
    df = spark.createDataFrame(rows, "k string, s int, v int").withColumn("t", F.timestamp_seconds("s"))
    got = relational.sliding_totals(df, "k", "t", F.col("v"), 10, 25).where("s is not null").select("k", "s", "v", "window_count", "window_total").collect()
    want = [(k, s, v, *map(sum, zip(*[(1, y) for q, x, y in rows if q == k and x is not None and s - 10 < x <= s]))) for k, s, v in rows if s is not None]
    assert sorted(map(tuple, got)) == sorted(want)


def test_deadlines_without_rules(spark):
    cases = spark.createDataFrame([(1, None, None)], "id int, base date, done date")
    none = spark.createDataFrame([], "rule string, n int, unit string")
    assert deadlines.deadline_rows(cases, none, "base", "done", F.current_date()).collect() == []


def test_book_search(spark):
    o = outline.outlined(outline.lines_of(spark.createDataFrame([(1, BOOK)], "doc_id long, text string")))
    found = lambda q: [(r.article, r.place, r.score, r.hits) for r in search.search_book(o, q).orderBy("rank").collect()]
    assert found("điều 2a") == [("2a", "name", 0, 1)]
    assert found("khoan hai") == [("1", "text", 51, 1)]
    assert found("nhiệm VU") == [("1", "name", 100, 1)]
    assert found("kho") == [("1", "text", 53, 3)]
    assert found("lời") == [("1", "comment", 31, 1)] and found("?") == [] and found("zzz") == []


def test_fields_of_documents(spark):
    kinds = spark.createDataFrame([("judgment", 2, r"(?m)^BẢN ÁN\b"), ("first", 1, "BẢN ÁN SỐ 1")], "kind string, place int, pattern string")
    rules = spark.createDataFrame([("day", 1, "date", r"ngày (\d+ tháng \d+ năm \d+)"), ("day", 2, "date", r"(\d+/\d+/\d{4})"), ("name", 1, "text", r"Tên *: *([^;\n]+)")], "field string, place int, form string, pattern string")
    docs = spark.createDataFrame([(1, "x\nBản án\nTên: An  Bình. ; a\nhôm 3/2/2020, ngày 1 tháng 2 năm 2021"), (2, "bản án số 1\nTên: "), (3, None), (4, "\n" * 70 + "BẢN ÁN\n31/2/2020")], "doc_id long, text string")
    c = fields.classified(docs, kinds)
    assert {r.doc_id: r.kind for r in c.collect()} == {1: "judgment", 2: "first", 3: "other", 4: "other"}
    got = {(r.doc_id, r.field): (r.value, r.quote) for r in fields.fields(c, rules, ["doc_id"]).collect()}
    assert got == {(1, "day"): ("2021-02-01", "hôm 3/2/2020, ngày 1 tháng 2 năm 2021"), (1, "name"): ("An Bình", "Tên: An  Bình. ; a")}
    assert fields.fields(docs, rules.where("false"), ["doc_id"]).collect() == []
    found = spark.createDataFrame([(7, 1, "a", "f", "x"), (7, 2, "b", "f", "y"), (7, 3, "b", "f", "x"), (7, 4, None, "g", "z")], "case_id int, doc_id int, kind string, field string, value string")
    trust = spark.createDataFrame([("f", "b", 1)], "field string, kind string, rank int")
    assert sorted(map(tuple, fields.case_fields(found, trust).collect())) == [(7, "f", "y", 2, 1, 1), (7, "g", "z", 4, 1, 0)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_clause_is_flattened_once(spark):
    """each value that was read flattened and cut the text again."""
    t = spark.createDataFrame([("trị giá từ 20.000 đồng\tđến dưới  50.000 đồng, thì bị phạt tù từ 01 năm đến 03 năm",)], "t string").select(F.col("t"))
    out = t.select(L.clause(F.col("t")).alias("c")).select("c.penalty.low", "c.penalty.high", F.get("c.ranges", 0)["to"].alias("to"))
    assert tuple(out.first()) == (12, 36, 50000)
    assert plan_of(out).count("regexp_replace(t#") == 1 and plan_of(t.select(L.penalty(F.col("t")))).count("regexp_replace(t#") == 1


def test_denials_meet_the_first_answer_of_each_word(spark):
    """every answer went out once for each four letters of its whole text, and met each denial of its record."""
    rows = [(1, n, "Anh kể về việc", "Có việc đó") for n in range(5, 40)] + [(1, 100 + n, "Anh kể về việc", "Tôi không hề biết") for n in range(40)] + [(1, 2, "Anh kể về việc", "Tôi không hề biết")]
    df = spark.createDataFrame(rows, "case_id long, n long, question string, answer string")
    out = statements.late_denials(df, "case_id")
    assert sorted(map(tuple, out.collect())) == [(1, 100 + n, 5) for n in range(40)]
    assert "LeftSemi" not in plan_of(out) and "min(__a" in plan_of(out).split("Join Inner", 1)[1]


def test_patterns_of_verbs_are_literals(spark):
    """the pattern of a verb was put together, and compiled, for each verb of each sentence; tokens were cut twice."""
    df = spark.createDataFrame([(1, 1, "Tôi nhận 1 triệu; không"), (1, 2, "nhận 2 triệu")], "case_id long, n long, answer string")
    out = statements.differing_sums(df)
    assert [(r.verb, r.n_sums, r.first_at) for r in out.collect()] == [("nhận", 2, 1)]
    assert "concat((?iu)" not in plan_of(out)
    assert plan_of(df.select(X.amounts(F.col("answer")))).count("regexp_extract_all(lower(answer#") == 1


def test_cases_stay_where_they_are(spark, tmp_path):
    """values went out to their frames and came back to the cases, whole, in one join."""
    from caseloom.plans import law_queries

    spark.createDataFrame([(1, k, 3 * k, 1, 5.0, v, 0.0, 0.0, "A", "F") for k, v in ((1, 60e3), (2, 1e3), (3, 600e3), (4, None))], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = law_queries.cases(spark, str(tmp_path))
    assert [r.fits for r in c.orderBy("n").select("fits").collect()] == [2, None, 4, None]
    assert len(re.findall(r"BroadcastHashJoin", c._jdf.queryExecution().executedPlan().toString().split("== Initial")[0])) == 3 and "SortMergeJoin" not in c._jdf.queryExecution().executedPlan().toString()


def test_flows_of_a_party_move_once(spark):
    """F16: sums, counterparts, first days and gaps were gathered apart and joined, each from flows of its own."""
    edges = spark.createDataFrame([("a", "b", 5.0, 2, 3), ("a", "b", None, 1, 1), ("b", "c", 2.0, 9, 2), (None, "c", 1.0, 1, 4)], "src string, dst string, amount double, n long, first_at int")
    drawn = spark.createDataFrame([("a", 1.0), ("x", 7.0)], "party string, amount double")
    out = flows.profiles(edges, drawn)
    want = {"a": ("source", 0, 5, 1, -4, 1, 1, ["b"], "no source,unknown"), "b": ("middle", 5, 2, 0, 3, 2, 1, ["c", "a"], "unknown,unspent"), "c": ("end", 3, 0, 0, 3, 2, 2, ["b", None], ""), "x": ("source", 0, 0, 7, 7, None, None, None, "unspent"), None: ("source", 0, 1, 0, -1, None, None, None, "")}
    assert {r.party: (r.role, r.total_in, r.total_out, r.withdrawn, r.balance, r.n_others, r.first_at, r.others, r.gaps) for r in out.collect()} == want
    assert plan_of(out).count("LogicalRDD") == 2
