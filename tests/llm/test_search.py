"""Ranked lexical search beside a score of every document."""

import math
import random
import re
from collections import Counter

from caseloom.llm import lexical_search as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, shard string, term int"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=20):
    held = [(d, Counter(w), len(w)) for d, t, *_ in docs if (w := split(t))]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def table(n, seed=3):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Été", "ß", "x"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda m: rnd.choice((" ", "-", "\n")).join(rnd.choices(words, weights, k=m))
    docs = [(k, text(rnd.randint(1, 60)).upper() if k % 7 == 0 else text(rnd.randint(1, 60)), "s", k) for k in range(n)]
    docs += [docs[5], docs[5], (n, docs[6][1], "s", 0), (None, docs[6][1], "s", 0), (n + 1, None, None, None), (n + 2, "", "", 0), (n + 3, "... !", "", 0)]
    docs.append((n + 4, text(20_000), "long", 1))
    return docs


ITEMS = [(1, "W3 w3 w20 W399 été"), (2, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w200 w201"), (3, None), (4, "nowhere"), (None, "w7, x; ß"), (5, "w50 w51 w52"), (5, "w50 w51 w52"), (6, "")]


def got(out):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=repr)


def test_search_finds_what_a_full_scan_finds(spark):
    docs = table(1200)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for shard_terms, query_bytes in ((L.SHARD_TERMS, L.QUERY_BYTES), (3000, 20)):
        index = L.build_index(df, shard_terms)
        assert got(L.search(index, items, query_bytes=query_bytes)) == brute(docs, ITEMS)
    assert got(L.search(index, items, k=1)) == brute(docs, ITEMS, 1)


def test_ties_go_by_doc_id(spark):
    docs = [(k, "same words here", "", 0) for k in range(300, 0, -1)]
    index = L.build_index(spark.createDataFrame(docs + [(999, "other", "", 0)], SCHEMA), 90)
    items = [(1, "same other")]
    assert got(L.search(index, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs + [(999, "other", "", 0)], items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(L.search(L.build_index(docs), items)) == []
    some = L.build_index(spark.createDataFrame([(1, "w50", "", 0)], SCHEMA))
    assert got(L.search(some, items.limit(0))) == []


def test_varints_round_trip():
    import numpy as np

    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**21, 2**28 + 5, 3])
    data, at = L.varints(values)
    assert at[-1] == len(data) and (L.read_varints(data) == values).all()


def test_blocks_below_the_threshold_stay_closed():
    """A rare term decides: common blocks that meet no pivot aren't decompressed."""
    import numpy as np

    rnd = random.Random(1)
    places, docs = L.Places(), []
    for d in range(20_000):
        words = [b"common"] * (1 + (d in range(5_000, 5_030)) * 40) + [b"filler%d" % rnd.randint(0, 50)] * 3
        docs.append((d, np.fromiter(map(places.__getitem__, words), "i4", len(words))))
    n_terms = sum(len(t) for _, t in docs)
    header, rows = L.shard_batches("0", docs, places, 20_000, n_terms)
    m = np.frombuffer(header.column("data")[0].as_py(), "<i8")
    lists = {r["term"]: L.PostingList(r["df"], r["block_last"], r["block_max"], r["block_at"], r["data"], m) for r in rows.to_pylist()}
    best = L.Best(20)
    L.search_shard([(b"common", 1000)], lists, np.arange(20_000), best)
    assert all(5_000 <= d < 5_030 for _, d in best.hits)
    assert lists[b"common"].is_open.sum() <= 3 < len(lists[b"common"].is_open)
