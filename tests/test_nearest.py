"""Similar rows of one group beside all pairs of it."""

import random

from pyspark.sql import functions as F

from caseloom.operators import nearest


def brute(rows, most):
    out = {}
    for a, d, ka, pa in rows:
        for b, e, kb, pb in rows:
            if a is not None and b is not None and d is not None and a != b and d == e:
                s = None if None in (ka, kb, pa, pb) else 1 + 3 * (ka == kb) + 2 * (abs(pa - pb) <= 0.5 * max(pa, pb))
                out.setdefault(a, []).append((s is None, -(s or 0), b, s))
    return sorted((a, x[2], x[3], k + 1) for a, xs in out.items() for k, x in enumerate(sorted(xs)[:most]))


def test_ranges_give_what_all_pairs_give(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([1, 2]), rnd.choice("aaaabbbbc") if k % 60 else f"z{k}", rnd.choice([0.0, -1.0, 1.0, 2.0, 4.0, 0.5, round(2 ** rnd.uniform(-3, 12), 2)])) for k in range(360)]
    rows += [(k, 1, None if k % 2 else "a", None if k % 3 == 0 else 5.0) for k in range(400, 406)]
    rows += [(500, 1, "a", 3.0), (500, 1, "b", 30.0), (501, 2, "a", 0.0004), (502, None, "a", 1.0), (None, 1, "a", 1.0), (503, 3, "a", 1.0)]
    rows = [(7 * r[0] % 1009 if r[0] is not None else None, *r[1:]) for r in rows]
    df = spark.createDataFrame(rows, "id long, d int, kind string, amount double")
    got = sorted(tuple(r) for r in nearest.most_similar(df, 3, 6).select("a", "b", F.col("score").cast("int"), "rank").collect())
    assert got == brute(rows, 3)


def test_a_large_group_makes_no_pairs(spark):
    df = spark.range(40000).select("id", F.lit(1).alias("d"), F.lit("a").alias("kind"), (F.lit(1.5) ** (F.col("id") * 7919 % 30)).alias("amount"))
    out = nearest.most_similar(df).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    assert (out.n, out.least) == (120000, 6)
