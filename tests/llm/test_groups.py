"""Near-duplicate groups with many near misses against brute force: the pairs that the
linker leaves out must not be links."""

import random

from caseloom.llm import linking, minhash_near


def shingled(text, words):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def tops(ids, near):
    up = {k: k for k in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {k: top(k) for k in ids}


def crowd(rng):
    """Copies of one text with few to many changes, families of copies of such copies, and one
    passage with tails of several lengths."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))

    def changed(ws, n):
        ws = list(ws)
        for _ in range(n):
            k = rng.randrange(len(ws))
            kind = rng.random()
            if kind < 0.6:
                ws[k] = word()
            elif kind < 0.8:
                del ws[k]
            else:
                ws.insert(k, word())
        return ws

    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = [base, passage]
    for _ in range(90):
        texts.append(changed(base, rng.randint(1, 11)))
    for _ in range(6):
        head = changed(base, 14)
        texts += [changed(head, rng.randint(1, 5)) for _ in range(12)]
    for _ in range(60):
        texts.append(passage + [word() for _ in range(rng.randint(1, 25))])
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def test_groups_among_near_misses(spark):
    for seed in (1, 2):
        rows = crowd(random.Random(seed))
        sets = {k: shingled(t, 2) for k, t in rows}
        near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = tops(sets, near)
        got = minhash_near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert 5 < len(set(want.values())) < len(rows) - 50


def test_least_shared_holds_for_all_links(spark):
    """Any link of which one row isn't linked to the reference shares what the rule says."""
    rng = random.Random(7)
    rows = []
    for _ in range(4000):
        ref = set(range(rng.randint(5, 40)))
        x = {k for k in ref if rng.random() > 0.25} | {100 + rng.randrange(12) for _ in range(rng.randint(0, 12))}
        y = {k for k in x if rng.random() > 0.08} | {100 + rng.randrange(12) for _ in range(rng.randint(0, 2))}
        if not x or not y or x == y:
            continue
        link = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
        if link(x, y) and not link(x, ref):
            rows.append((len(x ^ ref), len(x), len(y ^ ref), len(y), len(ref), len((x ^ ref) & (y ^ ref)), link(y, ref)))
    assert len(rows) > 300 and any(r[-1] for r in rows)
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "dx int, nx int, dy int, ny int, nr int, shared int, near boolean")
    x, y = (lambda c: F.col(c + "x")), (lambda c: F.col(c + "y"))
    ok = (
        (minhash_near.least_shared(F.col("dx"), F.col("nx"), F.col("nr"), F.lit(True)) <= F.col("shared"))
        & (minhash_near.least_shared(F.col("dy"), F.col("ny"), F.col("nr"), ~F.col("near")) <= F.col("shared"))
        & minhash_near.may_link(x, y, F.col("shared"))
    )
    assert df.where(~ok).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(a, b) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(120)) if a != b] + [(k, k + 1) for k in range(300, 340)]
    got = linking.components(spark.createDataFrame([(min(p), max(p)) for p in links], "a long, b long")).collect()
    want = tops({x for p in links for x in p}, [(min(p), max(p)) for p in links])
    assert {r.id: r.component for r in got} == want
