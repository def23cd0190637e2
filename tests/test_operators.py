import datetime

from pyspark.sql import functions as F

from caseloom.functions import extract as X, text as T
from caseloom.operators import language, relational as R, retrieval
from caseloom.streaming.windows import hourly_totals, session_totals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_kernels(spark):
    assert one(spark, T.fold(F.lit("Đường ÉTÉ"))) == "duong ete"
    assert one(spark, T.match_key(F.lit("  A--b,  c! "))) == "a b c"
    assert one(spark, T.slug(F.lit(" Ünder & Over "))) == "under-over"
    assert one(spark, T.edit_similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, T.sentences(F.lit("One. Two!\nThree"))) == ["One.", "Two!", "Three"]
    assert one(spark, T.percent(F.lit(1), F.lit(0))) == 0
    assert one(spark, T.html_strip(F.lit("<p>a &lt; b</p><script>x</script><p>c</p>"))) == "a < b\nc"


def test_extraction(spark):
    got = one(spark, X.amounts(F.lit("5,5 triệu rồi 1.200 nghìn, 3 tỷ và 7 ngàn")))
    assert [float(x) for x in got] == [5.5e6, 1.2e6, 3e9, 7e3]
    assert one(spark, X.dates(F.lit("ngày 31/02/2020 và 1/3/2020"))) == [datetime.date(2020, 3, 1)]
    said = [float(x) for x in one(spark, X.amounts(F.lit("1.200.000 đồng, 50,000 VND, 300.000 cái, 12 đồng, 2 triệu đồng")))]
    assert said == [1.2e6, 5e4, 2e6]
    cited = lambda s: [(r["article"], r["clause"], r["points"]) for r in one(spark, X.citations(F.lit(s)))]
    assert cited("điểm b, s khoản 1 Điều 51 và Điều 174a") == [("51", 1, ["b", "s"]), ("174a", None, [])]
    assert cited("điểm b, s khoản 1, khoản 2 Điều 51") == [("51", 1, ["b", "s"]), ("51", 2, [])]
    assert cited("khoản 9. Theo điểm a điểm c và đ khoản 3 Điều 7; điểm e Điều 8") == [("7", 3, ["c", "đ"]), ("8", None, ["e"])]
    assert cited("không có gì") == []
    assert one(spark, X.roll_weekend(F.lit("2024-06-01").cast("date"))) == datetime.date(2024, 6, 3)


def test_chunks_hold_all_paragraphs(spark):
    df = spark.createDataFrame([(1, "a" * 500 + "\n" + "b" * 500 + "\n\nc"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.chunk_no): r.chunk for r in retrieval.pack_chunks(df).collect()}
    assert rows == {(1, 0): "a" * 500, (1, 1): "b" * 500 + "\nc"}


def test_merges(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, v int, x string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "id int, v int, x string")
    assert {(r.id, r.x) for r in R.upsert(base, new, "id", "v").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {(r.id, r.change) for r in R.diff(base, new, "id", "x").collect()} == {(1, "removed"), (2, "changed"), (3, "added")}
    spans = spark.createDataFrame([("g", 0, 5), ("g", 0, 9), ("g", 8, 10), ("g", 9, 12)], "k string, s long, e long")
    assert {(r.s, r.e) for r in R.non_overlapping(spans, "k", "s", "e").collect()} == {(0, 9), (9, 12)}


def test_correction_prefers_known_pairs(spark):
    df = spark.createDataFrame([(1, "hoa don"), (2, None)], "id long, text string")
    words = spark.createDataFrame([("hoá", 50), ("hóa", 50), ("đơn", 60), ("đón", 70)], "word string, n long")
    pairs = spark.createDataFrame([("hoá", "đơn", 40)], "first string, second string, n long")
    assert {r.id: r.corrected for r in language.corrected(df, words, pairs).collect()} == {1: "hoá đơn", 2: None}


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    t = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    rows = [(1, t(0), "a", 1.0), (1, t(10), "a", 2.0), (2, t(70), "b", 3.0), (2, t(200), "a", 4.0)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double")
    df.write.parquet(src)
    for make, name in ((hourly_totals, "hours"), (session_totals, "visits")):
        q = make(spark.readStream.schema(df.schema).parquet(src), late="10 minutes").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {tuple(r) for r in spark.table(name).collect()}
        whole = {tuple(r) for r in make(df).collect()}
        assert got and got <= whole  # the last window stays open until the watermark passes it


def test_document_operators(spark):
    from caseloom.functions import measures as M
    from caseloom.operators import documents as D

    df = spark.createDataFrame([(1, "intro\nBy A (x)\none\ntwo\nBy B (y)\n"), (2, "none"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.part, r.speaker, r.role, r.text) for r in D.split_statements(df, r"By (\w) \((\w)\)").collect()}
    assert got == {(1, 0, "A", "x", "one\ntwo"), (1, 1, "B", "y", "")}
    texts = spark.createDataFrame([(1, "Pay 5 now please ok.\npay 5 NOW please ok.\nnothing to see here"), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n_kept) for r in D.information_filter(texts, "[0-9]", "copyright", least=10).collect()}
    assert out == {1: ("Pay 5 now please ok.", 1), 2: (None, -1), 3: ("", -1)}
    assert one(spark, D.stitch(F.lit("abc" * 10 + "overlapping text"), F.lit("overlapping text end"))) == "abc" * 10 + "overlapping text end"
    assert one(spark, D.stitch(F.lit("a"), F.lit("b"))) == "a\nb"
    assert one(spark, M.money(F.lit(1_250_000_000))) == "1,25 tỷ" and one(spark, M.money(F.lit(12_500))) == "12.500 đồng"
    assert one(spark, M.duration_months(F.lit("02 năm 06 tháng"))) == 30 and one(spark, M.duration_months(F.lit("x"))) is None
    s = spark.createDataFrame([(1, "The cat sat on a mat. The cat ran home today. Short one.")], "doc_id long, text string")
    assert [r.pos for r in D.summary_sentences(s).collect()] == [0]


def test_intervals_before_the_epoch(spark):
    from caseloom.operators import relational as R

    rows = spark.createDataFrame([(1, -100, -90), (1, -95, -80), (1, -80, -70), (1, 5, 9)], "g int, s long, e long")
    assert sorted((r.s, r.e) for r in R.non_overlapping(rows, "g", "s", "e").collect()) == [(-100, -90), (-80, -70), (5, 9)]


def test_repeats_with_nulls(spark):
    from caseloom.operators import relational as R

    rows = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, "a"), (1, 5, None)], "g int, k int, v string")
    assert sorted(r.k for r in R.drop_adjacent_repeats(rows, ["g"], ["k"], F.col("v")).collect()) == [1, 3, 5]


def test_seal_draws_a_nonce_for_each_row(spark):
    from caseloom.functions import measures as M

    key = "0123456789abcdef0123456789abcdef"
    sealed = spark.range(50).select(M.seal(F.concat(F.lit("same"), F.col("id").cast("string")), key, F.lit("n")).alias("s")).collect()
    assert len({bytes(r.s)[:12] for r in sealed}) == 50


def test_flow_roles_go_by_flows(spark):
    from caseloom.operators import flows

    edges = spark.createDataFrame([("a", "b", None), ("b", "c", 5.0)], "src string, dst string, amount double")
    assert {r.party: r.role for r in flows.balances(edges).collect()} == {"a": "source", "b": "middle", "c": "end"}
    assert {(r.party, r.gap) for r in flows.gaps(edges).collect()} == {("a", "unknown"), ("b", "unknown"), ("b", "no source")}
