"""Syllables and old encodings: lists of words, round trips over all letters, both forms of Unicode."""

import itertools
import unicodedata

from pyspark.sql import functions as F

from caseloom.functions import syllables as S

GOOD = "thương nghiêng quyết giếng gì gìn yêu iu khuya huỳnh của nghĩa được việc oanh quý quỳnh ghế kể cá ngã nghỉ đoóc boong hòa hoà uỷ ủy ăn ong ếch a y quốc".replace("quốc ", "").split()
BAD = {"": "empty", "thôngg": "rhyme", "nghành": "ng or ngh", "ghà": "g or gh", "kà": "c or k", "cể": "c or k", "ge": "g or gh", "ngê": "ng or ngh", "đươc": "tone of a stopped rhyme", "viềc": "tone of a stopped rhyme", "fan": "foreign letter", "a1": "strange sign", "th": "rhyme", "qa": "q without u", "quung": "rhyme after qu", "tyên": "iê or yê", "iên": "iê or yê", "áá": "two tones", "côgn": "rhyme"}


def each(spark, words, f):
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string")
    return [r.x for r in rows.select("k", f(F.col("w")).alias("x")).orderBy("k").collect()]


def test_syllables(spark):
    for form in ("NFC", "NFD"):
        words = [unicodedata.normalize(form, w) for w in [*GOOD, *(g.upper() for g in GOOD)]]
        assert dict(zip(words, each(spark, words, S.problem))) == dict.fromkeys(words)
        words = [unicodedata.normalize(form, w) for w in BAD]
        assert each(spark, words, S.problem) == list(BAD.values())
    assert each(spark, [None], S.problem) == [None]


def test_tones_go_and_come_back(spark):
    bases = sorted({(i if i != "-" else "") + r for i, r in itertools.product(("-", "b", "ngh", "qu", "gi", "kh"), S.rhymes())})
    rows = spark.createDataFrame([(b, t) for b in bases for t in range(6)], "b string, t int").withColumn("w", S.with_tone(F.col("b"), F.col("t")))
    got = rows.select("b", "t", "w", S.toneless(F.col("w")).alias("b2"), S.tone_digits(F.col("w")).alias("t2"), S.problem(F.col("w")).alias("p"), S.misplaced(F.col("w")).alias("m")).collect()
    for r in got:
        assert r.b2 == r.b and (r.t2 or "0") == str(r.t) and r.m is None, r
    shown = {(r.b, r.t): r.w for r in got}
    assert [shown[k] for k in [("quy", 2), ("gia", 1), ("oai", 2), ("uyên", 5), ("ươn", 3), ("ua", 4), ("khuya", 0), ("boan", 2), ("boa", 2)]] == ["quý", "già", "oái", "uyện", "ưởn", "ũa", "khuya", "boán", "boá"]


def test_misplaced_tones(spark):
    words = ["cuả", "nghiã", "của", "hòa", "hoà", "thúy", "thuý", "quí", "toan", None, "gíang"]
    assert each(spark, words, S.misplaced) == ["của", "nghĩa", None, None, None, None, None, None, None, None, "giáng"]
    assert each(spark, [unicodedata.normalize("NFD", "cuả"), unicodedata.normalize("NFD", "của")], S.misplaced) == ["của", None]


def test_valid_share(spark):
    assert each(spark, ["Tối cao xyz", "", None, "dàiquáđibạn ăn"], S.valid_share) == [2 / 3, 0.0, 0.0, 1.0]


def to_vni(text):
    back = {v: k for k, v in reversed(S.vni_codes().items()) if not (len(k) == 2 and k[0].isupper() and k[1].islower())}
    return "".join(back.get(c, c) for c in text)


def test_old_encodings_come_back(spark):
    letters = "".join(S.TONED) + "".join(S.TONED.values()) + "đ"
    said = ["Cộng hòa xã hội chủ nghĩa Việt Nam", "độc lập tự do hạnh phúc", "Tòa án nhân dân tối cao tuyên án", "đường phố được mở rộng, người dân phấn khởi"]
    tcvn = {v: k for k, v in zip(S.TCVN, S.TCVN_LETTERS) if k != "μ"}
    one = ["".join(tcvn.get(c, c) for c in t) for t in [letters, *said]]
    assert each(spark, one, S.from_tcvn) == [letters, *said]
    marked = [" ".join(letters), *said]
    assert each(spark, [to_vni(t) for t in marked], S.from_vni) == marked
    assert each(spark, [to_vni(t.upper()) for t in marked], S.from_vni) == [t.upper() for t in marked]
    assert each(spark, one[1:], S.encoding) == ["tcvn"] * 4
    assert each(spark, [to_vni(t) for t in said], S.encoding) == ["vni"] * 4
    assert each(spark, [*said, "Plain English text", "café à Paris", None, ""], S.encoding) == [None] * 8
    assert each(spark, [one[1], to_vni(said[1]), said[2]], lambda w: S.modern(w, S.encoding(w))) == said[:3]


def test_a_word_of_a_text_is_parsed_once(spark):
    """each occurrence of a word was parsed, and plain letters were searched for tones."""
    df = spark.createDataFrame([("nhà Nhà nhà fax cat catcatcat",), ("",), (None,)], "t string")
    out = df.select(S.valid_share(F.col("t")).alias("s"))
    assert [r.s for r in out.collect()] == [3 / 5, 0.0, 0.0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "^[a-z]*$" in plan
