"""Collections, paths, damaged JSON at every place of the cut, and searches with snippets."""

import json

from pyspark.sql import functions as F

from caseloom.operators import search as S
from caseloom.sources import collections as C


def walk(x, path="$"):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from walk(v, f"{path}['{k}']")
    elif isinstance(x, list):
        for k, v in enumerate(x):
            yield from walk(v, f"{path}[{k}]")
    else:
        yield path, x


def test_leaves_of_any_depth(spark):
    whole = {"r1": {"a": 1, "b": {"c": [1, {"d": "x"}, []], "e": None}}, "r2": {}, "r3": 5, "r4": [[["deep"]]]}
    rows = spark.createDataFrame([(1, json.dumps(whole)), (2, "not json"), (3, None), (4, '["q", {"z": true}]')], "id int, j string")
    got = C.leaves(C.records(rows, ["id"], "j"), ["id", "record"]).collect()
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    want = [(1, r, p, text(v)) for r, x in whole.items() for p, v in walk(x)] + [(4, "0", "$", "q"), (4, "1", "$['z']", "true")]
    assert sorted(map(repr, ((r.id, r.record, r.path, r.value) for r in got))) == sorted(map(repr, want))


def test_values_at_paths(spark):
    rows = spark.createDataFrame([('{"a":{"b":[1,2]}}', "a.b.1", "9"), ('{"a":1}', "x.y", '"new"'), ('{"a":1}', "a.b", "2"), ("broken", "a", "1"), (None, "a", "1"), ("[1]", "5", "1")], "j string, p string, v string")
    got = [r.x for r in rows.select(C.with_path("j", "p", "v").alias("x")).collect()]
    assert got == ['{"a":{"b":[1,9]}}', '{"a":1,"x":{"y":"new"}}', '{"a":1}', "broken", None, "[1]"]
    v = rows.limit(1).select(F.try_parse_json("j").alias("v"))
    assert v.select(C.at_path(F.col("v"), "$.a.b[1]", "int"), C.at_path(F.col("v"), "$.a.c")).first() == (2, None)


def test_what_is_whole_of_a_cut_object_is_kept(spark):
    whole = {"a": "x, \"y\" {", "list": [1, {"k": [True, None]}, "z\\"], "o": {"p": 1, "q": 2}, "end": 3}
    text = json.dumps(whole)
    said = [f"Sure! ```{text[:k]}" for k in range(len(text) + 1)] + [None, "", "none", "{}", "{broken}", 'see {"a": 1} and {"b"'] + [text + " {"]
    got = [r.x for r in spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string").select("k", C.salvaged("s").alias("x")).orderBy("k").collect()]
    assert got[len(text)] == json.dumps(whole, separators=(",", ":"))
    assert got[len(text) + 1 :] == [None, None, None, "{}", None, '{"a":1}', got[len(text)]]
    before = {}
    for x in got[: len(text) + 1]:
        now = json.loads(x) if x else {}
        assert set(before) <= set(now) <= set(whole)  # longer cuts never know less
        for k, v in now.items():
            assert v == whole[k] or (k == "list" and whole[k][: len(v)] == v) or (isinstance(v, list) and len(v) <= 3) or k == "o"
        before = now
    assert json.loads(got[len(text) - 1])["o"] == whole["o"]


def test_search_by_word_beginnings(spark):
    rows = [("a", 1, "Án lệ", "Bị cáo Bình và An"), ("a", 2, "x", "ban án lễ"), ("a", 3, None, "AN-LE 5/2020"), ("b", 4, "an", None), ("b", 5, "le an", "")]
    df = spark.createDataFrame(rows, "kind string, id long, title string, text string")
    got = [(r.kind, r.id, r.in_title, r["rank"], r.n) for r in S.search(df, "án LÊ").orderBy("kind", "rank").collect()]
    assert got == [("a", 1, True, 1, 3), ("a", 2, False, 2, 3), ("a", 3, False, 3, 3), ("b", 5, True, 1, 1)]
    assert [r.id for r in S.search(df, "5/20").collect()] == [3]
    assert S.search(df, " ,; ").collect() == []
    long = spark.createDataFrame([("word " * 60 + "Needle " + "word " * 60,)], "t string").select(S.snippet(F.col("t"), ["need"]).alias("s")).first().s
    assert long.startswith("…") and long.endswith("…") and "Needle" in long and len(long) == 112


def test_catalogue_and_candidates(spark):
    rows = [("123", "Tội giết người", ["đâm"], ["chết"], 1), ("134", "Gây thương tích", ["đánh người", None], ["vết"], 2), ("12", None, None, None, 3)]
    df = spark.createDataFrame(rows, "number string, name string, acts array<string>, signs array<string>, place int")
    find = lambda q: [(r.number, r.score) for r in S.search_catalogue(df, q).collect()]
    assert find("NGUOI") == [("123", 40), ("134", 20)] and find("Điều 12") == [("12", 100)] and find("chet") == [("123", 5)] and find(" ") == [] and find("zz") == []
    c = [(1, "a", True, None, None, None, None, 3), (1, "b", False, True, True, "high", True, 0), (1, "c", None, None, False, "high", None, 0), (1, "a", None, None, True, None, None, 1), (2, "z", None, None, None, None, None, None)]
    got = S.ranked_candidates(spark.createDataFrame(c, "doc_id int, article string, cited boolean, is_primary boolean, shown boolean, level string, seeded boolean, evidence int"))
    assert [(r.doc_id, r.article, r.score, r["rank"]) for r in got.orderBy("doc_id", "rank").collect()] == [(1, "b", 158, 1), (1, "a", 153, 2)]


def test_leaves_are_taken_apart_from_one_stored_table(spark, monkeypatch):
    """each level was stored, and the first one's rows were made again for the result."""
    stored = []
    monkeypatch.setattr(C, "materialize", lambda df, label: stored.append(label) or df.localCheckpoint())
    rows = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": 2}]}, "e": 5}')], "id int, j string").select("id", F.try_parse_json("j").alias("value"))
    assert sorted(r.path for r in C.leaves(rows, ["id"]).collect()) == ["$['a']['b'][0]", "$['a']['b'][1]['c']", "$['e']"]
    assert len(stored) == 1
    assert [r.path for r in C.leaves(rows, ["id"], deepest=2).collect()] == ["$['e']"]
