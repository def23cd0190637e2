"""Spelling correction beside a search over all paths."""

import itertools
import math
import random
import re

from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import language

WORDS = {"tối": 30, "toi": 2, "tội": 25, "cao": 40, "cáo": 12, "án": 22, "an": 9, "lệ": 8, "le": 5, "tòa": 11, "toà": 4, "và": 50}
PAIRS = {("tòa", "án"): 10, ("án", "lệ"): 6, ("tối", "cao"): 9, ("tội", "cáo"): 2, ("và", "tội"): 3, ("an", "le"): 4}


def fold(spark, words):
    return {r.w: r.f for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.fold(F.col("w")).alias("f")).collect()}


def brute(line, skeleton):
    total, kinds = sum(WORDS.values()), len(WORDS)

    def logp(prev, cur):
        uni = (WORDS.get(cur, 0) + 0.5) / (total + 0.5 * kinds)
        c = WORDS.get(prev, 0)
        if not prev or not c:
            return math.log(uni)
        lam = c / (c + 3)
        return math.log(lam * PAIRS.get((prev, cur), 0) / c + (1 - lam) * uni + 1e-9)

    toks = re.findall(r"[^\W\d_]+", line)
    states = []
    for k, t in enumerate(toks):
        w = t.lower()
        name = bool(re.fullmatch(r"[A-ZĐÀ-Ỹ][a-zđà-ỹ]+", t)) and k > 0 and toks[k - 1][0].isupper()
        like = sorted((x for x in WORDS if skeleton.get(x) == skeleton.get(w, w)), key=lambda x: (-WORDS[x], x))[:12]
        capitals = t.upper() == t and skeleton.get(w, w) == w
        may = len(t) > 1 and not name and (w not in WORDS or capitals)
        own = (w, 5.0 if may and like and w not in WORDS else 0.0)
        states.append([own, *((x, 0.0 if w not in WORDS else 1.2) for x in like if x != w and may)])
    best = None
    for path in itertools.product(*states):
        s = sum(logp(path[k - 1][0] if k else None, w) - pen for k, (w, pen) in enumerate(path))
        if best is None or s > best[0] + 1e-12:
            best = (s, [w for w, _ in path])
    return best[1] if best else []


def test_correction_is_the_best_path(spark):
    rnd = random.Random(3)
    pool = [*WORDS, "toa", "tôi", "caO", "AN", "LE", "TOI", "Toa", "xyz", "le", "và", "lê"]
    lines = [(k, " ".join(rnd.choices(pool, k=rnd.randint(0, 7)))) for k in range(150)] + [(900, None), (901, ""), (902, "12, 3!"), (903, "TOI CAO, (toa) an")]
    words = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    pairs = spark.createDataFrame([(*k, n) for k, n in PAIRS.items()], "first string, second string, n long")
    skeleton = fold(spark, {*WORDS, *(p.lower() for p in pool)})
    got = {r.id: r for r in language.corrected(spark.createDataFrame(lines, "id long, text string"), words, pairs).collect()}
    assert len(got) == len(lines)
    for k, line in lines:
        if line is None:
            assert got[k].corrected is None
            continue
        assert [w.lower() for w in re.findall(r"[^\W\d_]+", got[k].corrected)] == brute(line, skeleton), line
        assert re.sub(r"[^\W\d_]+", "#", got[k].corrected) == re.sub(r"[^\W\d_]+", "#", line)
    assert got[903].corrected == "TỐI CAO, (tòa) an"
    assert sum(r.n_changed for r in got.values()) > 50
    assert language.corrected(spark.createDataFrame([], "id long, text string"), words, pairs).collect() == []
