"""How far rows move: results are tested beside the operators."""

import re

from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import documents, recognisers, retrieval


def exchanges(df) -> list[str]:
    """Keys of the shuffles of a plan, before it runs."""
    return re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def keys(df) -> list[str]:
    return [re.sub(r"#\d+L?", "", x) for x in exchanges(df)]


def test_scenes_meet_by_document_once(spark):
    """F8: hits met by their phrases, and again for each step; adaptive execution put them into few tasks by their compressed bytes."""
    sents = spark.createDataFrame([(1, 0, "of the house"), (1, 1, "to the house"), (2, 0, "of the")], "doc_id long, pos int, sentence string")
    topics = spark.createDataFrame([("a", "t1", "of the", "find", 2, False), ("a", "t2", "to the", "find", 2, False)], "topic string, phrase_id string, phrase string, kind string, weight long, solo boolean")
    out = recognisers.best_scenes(sents, topics)
    assert keys(out) == ["doc_id"]
    assert sorted(map(tuple, out.select("doc_id", "scene", "strong", "score").collect())) == [(1, 0, True, 4), (2, 0, False, 2)]
    hits = recognisers.phrase_hits(sents, ["doc_id", "pos"], "sentence", topics)
    from caseloom.session import dealt

    assert dealt(hits, sents, "doc_id").rdd.getNumPartitions() == 8 * sents.rdd.getNumPartitions()  # grows with the scan; not coalesced


def test_elements_meet_by_document_once(spark):
    """near and wide elements met in joins by document and rule, and scenes by rule alone."""
    sents = spark.createDataFrame([(1, 0, "who"), (1, 4, "where"), (2, 7, "where")], "doc_id long, pos int, sentence string")
    els = spark.createDataFrame([("1", "who", 3, True, False, None), ("1", "where", 1, False, True, None)], "rule string, element string, weight long, required boolean, anywhere boolean, least double")
    phrases = spark.createDataFrame([("1/who", "who", "find"), ("1/where", "where", "find")], "phrase_id string, phrase string, kind string")
    out = recognisers.recognised(sents, els, phrases)
    assert [k for k in keys(out) if k != "rule"] == ["doc_id"]
    assert sorted(map(tuple, out.collect())) == [(1, "1", 0, True, "high", 4, 4, ""), (2, "1", 7, False, "none", 1, 4, "who")]


def test_terms_are_counted_in_their_rows(spark):
    """every word and pair of every text was shuffled."""
    docs = spark.createDataFrame([(1, "red car red car blue"), (1, "blue sky"), (2, None), (3, "xx xx xx"), (4, "")], "doc_id long, text string")
    out = documents.keyword_frequency(docs)
    assert keys(out) == ["doc_id"]
    assert sorted(map(tuple, out.collect())) == [(1, "blue", 2.0, 2), (1, "red car", 3.2, 1), (3, "xx xx", 3.2, 1)]


def test_counts(spark):
    rows = spark.createDataFrame([(["b", "a", "b", None],), ([],), (None,)], "v array<string>")
    assert [r.c for r in rows.select(T.counts(F.filter("v", lambda x: x.isNotNull())).alias("c")).collect()] == [[("a", 1), ("b", 2)], [], None]


def test_scores_are_added_where_the_postings_are(spark):
    """every pair of query and chunk was shuffled, and again to meet its length."""
    docs = spark.createDataFrame([(1, "green tea pot"), (2, "evergreen teapots"), (3, "tea")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "green tea"), (8, "of the")], "item_id long, text string")
    out = retrieval.rank_chunks(docs, queries)
    assert keys(out) == ["item_id", "doc_id, chunk_no"]
    assert [r.doc_id for r in out.orderBy("rank").collect()] == [1, 2, 3]  # the second holds the query within words, and none of its terms


def test_documents_are_scored_where_their_postings_are(spark):
    """postings met by their words, and every pair of query and document was shuffled."""
    docs = spark.createDataFrame([(1, "green tea pot"), (2, "tea tea")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "green tea")], "item_id long, text string")
    out = retrieval.tf_idf_rank(docs, queries)
    assert "doc_id" in keys(out) and not any("item_id, doc_id" in k for k in keys(out))
    assert [r.doc_id for r in out.orderBy("rank").collect()] == [1, 2]


def test_words_meet_by_form(spark, monkeypatch):
    """every word met the model by itself, and all words without a choice met in one task, under a null key."""
    from caseloom.operators import language

    docs = spark.createDataFrame([(1, "tối cao tối cao tòa án tòa án"), (2, "tối cao tòa án cao"), (3, None)], "doc_id long, text string")
    words, pairs = language.spelling_model(docs)
    assert "Generate" not in pairs._jdf.queryExecution().executedPlan().toString()  # the texts are cut once
    assert {r.word: r.n for r in words.collect()} == {"tối": 3, "cao": 4, "tòa": 3, "án": 3}
    assert {(r.first, r.second): r.n for r in pairs.collect()} == {("tối", "cao"): 3, ("tòa", "án"): 3, ("cao", "tòa"): 2}
    lines = spark.createDataFrame([(1, "toi cao va toa an"), (2, ""), (3, None), (4, "toi toi TOA")], "id long, text string")
    got = []
    for often in (1, 2, 1000):  # all forms broadcast, some, none
        monkeypatch.setattr(language, "OFTEN", often)
        got.append(sorted(map(tuple, language.corrected(lines, words, pairs).collect())))
    assert got[0] == got[1] == got[2]
    assert got[0] == [(1, "toi cao va toa an", "tối cao va tòa án", 3), (2, "", "", 0), (3, None, None, 0), (4, "toi toi TOA", "tối tối TÒA", 3)]


def test_few_ranges_go_to_many_points(spark):
    """rows were shuffled by the wide bins of a few ranges, so one task read most of them."""
    from caseloom.operators import ranges

    points = spark.createDataFrame([(k, float(k)) for k in range(1000)], "id long, v double")
    bands = spark.createDataFrame([(1, 0.0, 500.0), (2, 400.0, None)], "band int, lo double, hi double")
    out = ranges.at_point(points, bands, "v", "lo", "hi", closed=False)
    assert exchanges(out) == []
    assert sorted(map(tuple, out.groupBy("band").count().collect())) == [(1, 500), (2, 600)]


def test_lines_are_dealt_out_by_text_once(spark):
    """adaptive execution put the lines of many texts into few tasks by their compressed bytes."""
    from caseloom.operators import outline

    docs = spark.createDataFrame([(1, "Điều 1. Name\n1. one"), (2, "x")], "doc_id long, text string")
    out = outline.outlined(outline.lines_of(docs))
    assert keys(out) == ["doc_id"]
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.select("doc_id", "n", "kind", "clause").collect())) == [(1, 0, "article", None), (1, 1, "body", 1), (2, 0, "title", None)]


def test_aliases_meet_once(spark):
    """aliases were made distinct by person in a shuffle of their own before they were counted."""
    from caseloom.operators import people

    r = spark.createDataFrame([(1, "lan", "hoa lan", "clear"), (1, "mai lan", "mai lan", "clear"), (1, "x", "x", "partial"), (2, "an", "hoa an", "clear")], "case_id long, key string, person string, status string")
    out = people.aliases(r)
    assert keys(out) == ["case_id, alias"]
    assert sorted(map(tuple, out.collect())) == [(1, "hoa lan", "hoa lan"), (1, "mai lan", "mai lan"), (2, "hoa an", "an"), (2, "hoa an", "hoa an")]
