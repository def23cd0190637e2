"""Phrases, scenes, people, ranges and similar sets beside plain loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import people, ranges, recognisers, similarity

PHRASES = [("p1", "strike"), ("p2", "strike hard"), ("p3", "a b"), ("p4", "Ép buộc"), ("p5", "")]
HARMLESS = ["strike off", "a b c", "the strike", "strike"]
TEXTS = ["They STRIKE hard.", "a strike off the list; strike hard", "a b c a b", "bép buộc ép BUỘC", "x a bc a b", "the strike hard", None, "", "strikes strike", "İ strike hard", "no: deny me strike hard", "a b a b a b"]


def brute_hits(text, phrases, harmless, deny=()):
    low = recognisers.lowered(text or "")

    def at(p):
        p = p.lower()
        for i in range(len(low)):
            j = i + len(p)
            if p and low[i:j] == p and not (i and low[i - 1].isalnum() and p[0].isalnum()) and not (j < len(low) and low[j].isalnum() and p[-1].isalnum()):
                yield i, j

    if any(True for d in deny for _ in at(d)):
        return []
    bad = [s for h in harmless for s in at(h)]
    return sorted((p, i, j) for p, t in phrases for i, j in at(t) if not any(s < j and e > i and (s < i or e > j) for s, e in bad))


@pytest.mark.parametrize("block", [10**6, 8])
def test_phrase_hits(spark, block):
    rows = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(TEXTS)], "id long, text string, phrase_id string")
    table = [(i, p, "find") for i, p in PHRASES] + [("h", h, "harmless") for h in HARMLESS] + [("d", "deny me", "deny"), ("n", None, "find")]
    got = recognisers.phrase_hits(rows, ["id"], "text", spark.createDataFrame(table, "phrase_id string, phrase string, kind string"), block).collect()
    for k, t in enumerate(TEXTS):
        assert sorted((r.phrase_id, r.start, r.stop) for r in got if r.id == k) == brute_hits(t, PHRASES, HARMLESS, ["deny me"]), t


def test_no_phrases_or_no_rows(spark):
    rows = spark.createDataFrame([(1, "a b")], "id long, text string")
    none = spark.createDataFrame([], "phrase_id string, phrase string, kind string")
    assert recognisers.phrase_hits(rows, ["id"], "text", none).collect() == []
    some = spark.createDataFrame([("1", "a", "find")], "phrase_id string, phrase string, kind string")
    assert recognisers.phrase_hits(rows.limit(0), ["id"], "text", some).collect() == []


def scene_case(spark, seed):
    rnd = random.Random(seed)
    rows = [(d, s, " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 4)))) for d in range(30) for s in range(rnd.randint(1, 12))]
    return rows, spark.createDataFrame(rows, "doc_id long, pos int, sentence string")


def test_recognised_elements_and_amounts(spark):
    rows, sents = scene_case(spark, 1)
    elements = [("r", "x", 3, True, False, None), ("r", "y", 2, False, False, None), ("r", "z", 1, True, True, None), ("r", "money", 2, False, False, 50.0), ("q", "x", 1, False, False, None)]
    phrases = [("r/x", "a", "find"), ("r/x", "b", "find"), ("r/y", "c d", "find"), ("r/z", "e", "find"), ("q/x", "a", "find"), ("h", "a h", "harmless")]
    amounts = [(d, s, 10.0 * (s % 8)) for d, s, _ in rows if d % 3 == 0]
    out = recognisers.recognised(
        sents, spark.createDataFrame(elements, "rule string, element string, weight long, required boolean, anywhere boolean, least double"),
        spark.createDataFrame(phrases, "phrase_id string, phrase string, kind string"), amounts=spark.createDataFrame(amounts, "doc_id long, pos int, amount double"),
    ).collect()
    want = []
    for doc in range(30):
        for rule in "rq":
            has = {}
            for d, s, t in rows:
                if d == doc:
                    has[s] = {p.split("/")[1] for p, _, _ in brute_hits(t, [(i, p) for i, p, k in phrases if k == "find" and i.startswith(rule)], ["a h"])}
                    if rule == "r" and any(a[:2] == (d, s) and a[2] >= 50 for a in amounts):
                        has[s].add("money")
            own = [e for e in elements if e[0] == rule]
            best = None
            for s in has:
                near = set().union(*(has.get(s + k, set()) for k in range(3)))
                wide = {e[1] for e in own if e[4] and any(e[1] in h for h in has.values())}
                got = {e for e in near if not next(x for x in own if x[1] == e)[4]} | wide
                ok = all(e[1] in got for e in own if e[3])
                score = sum(e[2] for e in own if e[1] in got)
                order = (ok, score, sum(e[3] and e[1] in got for e in own), -s)
                if got and (best is None or order > best[0]):
                    best = (order, got)
            if best:
                most = sum(e[2] for e in own)
                (ok, score, _, _), got = best
                want.append((doc, rule, ok, "none" if not ok else "high" if score >= 0.75 * most else "medium", score, most, ",".join(sorted(e[1] for e in own if e[1] not in got))))
    assert sorted((r.doc_id, r.rule, r.ok, r.level, r.score, r.most, r.missing) for r in out) == sorted(want)
    assert {w[3] for w in want} == {"none", "medium", "high"}


def test_best_scenes(spark):
    rows, sents = scene_case(spark, 2)
    topics = [("t", "1", "a b", "find", 2, False), ("t", "2", "c", "find", 1, False), ("t", "3", "d", "find", 3, False), ("t", "4", "e f", "find", 1, True), (None, "h", "c d", "harmless", 0, False)]
    out = recognisers.best_scenes(sents, spark.createDataFrame(topics, "topic string, phrase_id string, phrase string, kind string, weight long, solo boolean")).collect()
    want = []
    for doc in range(30):
        has = {s: {p for p, _, _ in brute_hits(t, [(x[1], x[2]) for x in topics if x[0]], ["c d"])} for d, s, t in rows if d == doc}
        best = None
        for s in has:
            near = set().union(*(has.get(s + k, set()) for k in range(3)))
            own = [x for x in topics if x[1] in near]
            heavy = sum(x[4] >= 2 for x in own)
            order = (any(x[5] for x in own) or heavy >= 2 or (heavy >= 1 and len(own) >= 3), sum(x[4] for x in own), -s)
            if own and (best is None or order > best[0]):
                best = (order, len(own), next(k for k in range(s, s + 3) if has.get(k)))
        if best:
            want.append((doc, -best[0][2], best[0][0], best[0][1], best[1], best[2]))
    assert sorted((r.doc_id, r.scene, r.strong, r.score, r.n_hits, r.quote_at) for r in out) == sorted(want)


def by_walk(names):
    """From the longest name to the shortest, as a person would read them."""
    canon, out = [], {}
    for n in sorted(set(names), key=lambda n: -len(n.split())):
        found = [c for c in canon if out[c][1] != "ambiguous" and c.endswith(" " + n)]
        if len(found) == 1:
            out[n] = (found[0], "clear")
            continue
        out[n] = (n, "ambiguous") if found else (n, "partial" if " " not in n else "clear")
        canon.append(n)
    return out


def test_people(spark):
    rnd = random.Random(4)
    rows = []
    for case in range(40):
        full = [" ".join(rnd.choices(["An", "Bình", "Văn", "Lê", "Trần", "Đỗ"], k=rnd.randint(1, 4))) for _ in range(6)]
        rows += [(case, " ".join(n.split()[-rnd.randint(1, 4):]), rnd.random() < 0.5) for n in full for _ in range(3)]
    rows += [(1, None, None), (1, "", False), (1, " - ", True)]
    out = people.resolved_people(spark.createDataFrame(rows, "case_id long, name string, known boolean")).collect()
    for case in range(40):
        names = [n.lower() for c, n, _ in rows if c == case and n and n.strip(" -")]
        assert {r.key: (r.person, r.status) for r in out if r.case_id == case} == by_walk(names)
        assert sum(r.mentions for r in out if r.case_id == case) == len(names)
    assert people.resolved_people(spark.createDataFrame([], "case_id long, name string, known boolean")).collect() == []


def test_mentions(spark):
    said = [("Ông Nguyễn Văn An đưa tiền cho bà Lê Thị Cúc, kế toán Trần Bình Ban quản lý.",), ("Hoàng Thị Em gặp anh Bình và ông  Đỗ",), (None,), ("không có ai",)]
    got = spark.createDataFrame(said, "s string").select(people.mentions(F.col("s")).alias("m")).collect()
    assert [r.m for r in got] == [["Nguyễn Văn An", "Lê Thị Cúc", "Trần Bình"], ["Bình", "Đỗ"], None, []]


def test_aliases_of_one_person_only(spark):
    rows = [(1, "Trần Văn Bình", True), (1, "Lê Thị Bình", True), (1, "Bình", False), (1, "An Nam", True)]
    got = people.aliases(people.resolved_people(spark.createDataFrame(rows, "case_id long, name string, known boolean")))
    assert {(r.person, r.alias) for r in got.collect()} == {("trần văn bình", "trần văn bình"), ("trần văn bình", "văn bình"), ("lê thị bình", "lê thị bình"), ("lê thị bình", "thị bình"), ("an nam", "an nam"), ("an nam", "nam")}


def intervals(rnd, n, kind):
    out = []
    for k in range(n):
        s = rnd.choice([None, rnd.randint(-50, 50), rnd.randint(-(10**9), 10**9)]) if kind == "int" else rnd.choice([None, round(rnd.uniform(-20, 20), 2)])
        e = None if s is None or rnd.random() < 0.15 else s + rnd.choice([0, 1, 3, 100, 2**20, 10**12])
        e = rnd.randint(-5, 60) if s is None and rnd.random() < 0.7 else e
        out.append((k, rnd.choice(["x", "y", None]), s, e))
    return out


@pytest.mark.parametrize("kind", ["int", "float"])
@pytest.mark.parametrize("closed", [True, False])
def test_ranges_of_any_length(spark, kind, closed):
    rnd = random.Random(7)
    a, b = intervals(rnd, 120, kind), intervals(rnd, 120, kind)
    typed = "long" if kind == "int" else "double"
    rows = lambda x, n: [(i, g, *(None if v is None else v if kind == "int" else float(v) for v in (s, e))) for i, g, s, e in x]
    da = spark.createDataFrame(rows(a, "a"), f"a long, g string, s {typed}, e {typed}")
    db = spark.createDataFrame(rows(b, "b"), f"b long, g string, s2 {typed}, e2 {typed}")
    le = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
    meet = lambda s, e, s2, e2: (s2 is None or e is None or le(s2, e)) and (s is None or e2 is None or le(s, e2))
    proper = lambda s, e: s is None or e is None or (s <= e)
    got = ranges.overlapping(da, db, ("s", "e"), ("s2", "e2"), ["g"], closed).select("a", "b").collect()
    want = [(i, j) for i, g, s, e in a for j, h, s2, e2 in b if g is not None and g == h and proper(s, e) and proper(s2, e2) and meet(s, e, s2, e2)]
    assert sorted(map(tuple, got)) == sorted(want)
    points = da.select("a", "g", "s")
    at = ranges.at_point(points, db, "s", "s2", "e2", ["g"], closed).select("a", "b").collect()
    assert sorted(map(tuple, at)) == sorted((i, j) for i, g, s, _ in a for j, h, s2, e2 in b if s is not None and g is not None and g == h and proper(s2, e2) and (s2 is None or s2 <= s) and (e2 is None or le(s, e2)))
    other = db.withColumnRenamed("s2", "s").withColumnRenamed("e2", "e")
    alone = {r.a for r in ranges.not_overlapping(da, other, ("s", "e"), ["g"], closed).collect()}
    assert alone == {i for i, *_ in a} - {i for i, _ in want}
    assert "NestedLoop" not in ranges.overlapping(da, db, ("s", "e"), ("s2", "e2"))._jdf.queryExecution().executedPlan().toString()


def test_similar_sets_are_all_found(spark):
    rnd = random.Random(9)
    sets = lambda n: [(k, ["all", *rnd.sample([f"w{j}" for j in range(25)], rnd.randint(0, 8))]) for k in range(n)] + [(n, []), (n + 1, ["all"])]
    a, b = sets(150), sets(200)
    frame = lambda x: spark.createDataFrame(x, "id long, w array<string>")
    for least in (0.55, 0.7, 1.0):
        got = similarity.similar_sets(frame(a), frame(b), least).collect()
        want = [(i, j) for i, v in a for j, w in b if v and w and len({*v} & {*w}) >= least * len({*v} | {*w}) - 1e-12]
        assert sorted((r.a_id, r.b_id) for r in got) == sorted(want)


def test_tracked_questions(spark):
    q = [(1, "i", "Who paid him the money there?"), (2, "j", "Who paid him the money there?"), (3, "i", "Nothing like it"), (4, None, None), (5, "i", "Where? When!")]
    lines = [("i", "who paid her the money there", "I do"), ("j", "WHEN where", ""), ("j", "Where, when", " "), ("k", "where when", "maybe"), ("i", None, "x")]
    out = similarity.tracked(
        spark.createDataFrame(q, "question_id long, issue string, text string"), spark.createDataFrame(lines, "issue string, text string, answer string"), "maybe",
        spark.createDataFrame([("nothing like it", "skipped")], "key string, status string"),
    )
    assert sorted((r.question_id, r.asked, r.answered, r.status) for r in out.collect()) == [(1, 1, 1, "answered"), (2, 1, 1, "answered"), (3, 0, 0, "skipped"), (4, 0, 0, "open"), (5, 3, 1, "unclear")]


def test_sets_of_other_words_are_not_dealt(spark):
    df = spark.createDataFrame([("the", 9), ("who", 2)], "word string, n long")
    sets = spark.createDataFrame([(1, ["the", "x", "y", "z"]), (2, ["who", "the", "x"]), (3, ["x", "y"])], "id long, w array<string>")
    got = similarity.prefix(similarity.ordered(sets, df), 0.55)
    assert [(r.id, r.size, r.w, r.word) for r in got.collect()] == [(2, 3, ["who", "the"], "who")]
