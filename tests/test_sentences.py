"""Sentences keep their digits, and scores do not depend on the order that rows arrive in."""

from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import documents as D


def test_sentences_trim_spaces_only(spark):
    text = "0 at first.  1 then. \n 22 and 2\n3"
    got = spark.range(1).select(T.sentences(F.lit(text)).alias("s")).first().s
    assert got == ["0 at first.", "1 then.", "22 and 2", "3"]


def test_summary_sums_in_sentence_order(spark):
    # weights 30/224, 2/224, ...: in order they add up to just under 2.90625, in others to that or more
    df = [30, 2, 97, 65, 1, 158, 32, 17, 4, 103, 18, 1, 1, 54, 2, 66]
    last = " ".join(f"w{k}" for k in range(len(df)))
    top = ["z9"] * 224
    lines = ["  ".join([top[k], *(f"w{j}" for j, n in enumerate(df) if k < n - 1)]) for k in range(224)]
    docs = spark.createDataFrame([(1, "\n".join([*lines[:100], last, *lines[100:]]))], "doc_id long, text string")
    want = 0.0
    for n in df:
        want += n / 224
    assert want < 2.90625
    got = {r.pos: r.score for r in D.summary_sentences(docs, ratio=1.0).collect()}
    assert got[100] == 0.726562
