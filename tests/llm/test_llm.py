"""The ten operators against brute force on a small fixture with the awkward cases: nulls,
empty and very long texts, repeated rows, ties, clashing column names, empty tables."""

import collections
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import (
    chat_format,
    decontaminate,
    html_extract,
    line_dedup,
    minhash_near,
    packing,
    pretokens,
    quality_rules,
    suffix_dedup,
    token_counts,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, stats int, sequence_no int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7)))
    out = []
    passage = " ".join(word() for _ in range(70))
    for k in range(24):
        lines = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 5))]
        if k % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        out.append((k, "\n".join(lines)))
    base = out[3][1].split(" ")
    for k in range(24, 32):
        other = list(base)
        other[rng.randrange(len(other))] = word()
        out.append((k, " ".join(other)))
    out += [(32, out[5][1]), (33, None), (34, ""), (35, "one"), (36, "x y"), (37, " ".join(word() for _ in range(3000))), (38, "ab" * 700), (39, " lead  and\ttrail \n\n")]
    out.append(out[7])  # a repeated row
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1, "k", 2, 3) for k, t in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_cover_is_a_difference_set():
    gaps = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert len(gaps) == suffix_dedup.PERIOD


def test_suffix_dedup(docs, none, rows):
    counts = collections.Counter()
    data = [(k, (t or "").encode()) for k, t in rows]
    for _, b in data:
        counts.update(b[i : i + 200] for i in range(len(b) - 199))
    want = []
    for k, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if counts[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, "u1")[~gone])).hexdigest()))
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == sorted(want)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_packing(docs, none, rows):
    got = packing.pack_documents(docs).collect()
    tokenizer = pretokens.full_tokenizer()
    want = collections.Counter()
    for k, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(min(first, len(ids)), len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(k, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack_documents(none).count() == 0


def test_packing_needs_no_more_than_first_fit_decreasing():
    rng = random.Random(8)
    better = 0
    for k in range(12):
        counts = collections.Counter(min(1024, int(rng.lognormvariate(5.2 + k % 4 * 0.3, 0.8)) + 1) for _ in range(300 + 60 * k))
        rooms = []
        for n in sorted(counts.elements(), reverse=True):
            at = next((j for j, r in enumerate(rooms) if r >= n), None)
            if at is None:
                rooms.append(1024 - n)
            else:
                rooms[at] -= n
        bins = packing.minimum_bin_slack(counts)
        assert collections.Counter(x for lengths, n in bins for x in lengths * n) == counts and all(sum(b) <= 1024 for b, _ in bins)
        ours = sum(n for _, n in bins)
        assert ours <= len(rooms) + 1
        better += ours <= len(rooms)
    assert better >= 10


def test_fullest_is_optimal():
    rng = random.Random(1)
    for _ in range(50):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 90)
        sums = {0}
        for x, n in counts.items():
            for _ in range(n):
                sums |= {s + x for s in sums if s + x <= room}
        got = packing.fullest(room, counts)
        assert sum(got) == max(sums) and all(got.count(x) <= counts[x] for x in got)


def test_html(spark):
    page = """<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/>Home</a></nav>
    <div class="cookie-banner">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>First   <b>bold</b>
    text that goes on for a while.<p>Second &lt;i&gt; 2 < 3.</p><aside>Related</aside><form><p>Sign up</p></form>
    <div id="comments"><p>Nice article, thank you very much for it, I liked it.</p></div></article><footer>&copy; x</footer>"""
    rows = [(1, "u", page), (1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<" * 50 + "a" * 100_000)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 5 and by[1].text == "Head & line\nFirst bold text that goes on for a while.\nSecond <i> 2 < 3."
    assert by[2].text == by[3].text == "" and by[1].n_chars == len(by[1].text)


def test_html_goes_on_after_custom_elements_and_empty_svg():
    body = "<p>First text that goes on for a while.</p>%s<p>Second text that goes on for a while.</p>"
    want = ["First text that goes on for a while.", "Second text that goes on for a while."]
    for part in ("<svg-icon></svg-icon>", "<template-card></template-card>", '<svg width="1" />', "<svg/>", "<svg class=\"a>b\"/>", "<svg><path/><title>no</title></svg>", "<style>p{}</style>"):
        assert [b.text for b in html_extract.blocks_of(body % part)] == want, part
    assert [b.text for b in html_extract.blocks_of("<p>a<svg/>b</p>")] == ["ab"]


def test_html_wrappers_named_by_layout_keep_the_article():
    text = "A paragraph of an article that goes on for a good while, so that it is plainly content."
    for tag, names in (("article", "has-sidebar"), ("main", "layout no-sidebar"), ("div", "content with-nav"), ("div", "print-area"), ("div", "legal-page"), ("div", "post tags-open"), ("div", "main-content right-side")):
        page = f'<body><nav><a href="/">Home</a></nav><{tag} class="{names}"><h1>Head</h1><p>{text}</p><div class="related-posts"><p>Related things</p></div></{tag}><footer>x</footer>'
        assert html_extract.extract(page)[0] == f"Head\n{text}", names
    assert html_extract.extract(f'<article><p>{text}</p></article><div class="post-comments"><p>{text}</p></div>')[0] == text


def test_min_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 8)
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 1.5)) for _ in range(2 * n)]

        def cost(label):
            return sum(-u if u < 0 and x else u if u > 0 and not x else 0 for u, x in zip(unary, label)) + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.min_cut(unary, edges)) == pytest.approx(best)


def test_decontamination(spark, docs, rows):
    rng = random.Random(9)
    items = [(k, rows[k][1][:150]) for k in (1, 8, 14)] + [(90, None), (91, ""), (92, "one"), (93, "q" * 80), (94, " ".join(rows[4][1].split()[2:5])), (95, rows[6][1].split()[0][:2])]
    worn = list(rows[8][1][:150])
    worn[20:22] = "zzz"
    more = spark.createDataFrame([(100, "pre fix " + "".join(worn) + " after")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def distance(item, text):  # whole item against any part of the text
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    want = set()
    for k, t in [*rows, (100, more.first().text)]:
        for i, item in items:
            a, b = decontaminate.normalise(item), decontaminate.normalise(t)
            if k != 37 and len(a) >= decontaminate.MIN_CHARS and distance(a, b) <= int(len(a) * decontaminate.ERROR_SHARE):
                want.add((k, i, distance(a, b)))
            elif a and len(a) < decontaminate.MIN_CHARS and re.search(r"(?<![^\W_])" + re.escape(a) + r"(?![^\W_])", b):
                want.add((k, i, 0))
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(every, bench).collect()}
    assert got == want and any(k == 100 for k, _, _ in got)
    small = decontaminate.leaks(every, bench, block_chars=200)  # several blocks
    assert {(r.doc_id, r.item_id, r.distance) for r in small.collect()} == want
    bare = spark.createDataFrame([(None, rows[1][1]), (None, "clean"), (5, None)], "doc_id long, text string")
    nameless = spark.createDataFrame([(None, rows[1][1][:150])], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(bare, nameless).collect()} == {(None, None, 0)}
    assert sorted(r.text or "" for r in decontaminate.decontaminate(bare, nameless).collect()) == ["", "clean"]
    assert decontaminate.leaks(docs.where("false"), bench).count() == decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == docs.count()
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(k not in {x for x, _, _ in want} for k, _ in rows)


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "[\\INST] \\\\ [ROLE ab]x[/ROLE]", "<<SYS>>a<</SYS>>", "\n", "plain", None, ""]
    rows = []
    for c, roles in enumerate([["system", "user", "assistant", "user", "assistant"], ["user", "tool", None, "assistant", "user"], ["user"], ["assistant", "assistant"]]):
        rows += [(c, t, r, hard[(c + t) % len(hard)]) for t, r in enumerate(roles)]
    rows += [(9, 0, "user", h) for h in hard] + [(9, 1, "assistant", h) for h in hard] + [(9, 1, "assistant", "plain")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(0))
    got = {r.conv_id: r for r in chat_format.digest_examples(chat_format.expand_examples(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digest_examples(chat_format.expand_examples(df.where("false"))).count() == 0


def test_chat_of_very_many_turns(spark):
    n = 6000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.format_string("%s%s", F.repeat(F.lit("x"), 140), F.col("id").cast("string")).alias("text"))
    got = chat_format.digest_examples(chat_format.expand_examples(rows)).first()
    texts = ["x" * 140 + str(k) for k in range(n)]
    assert got.n_turns == n and got.n_examples == n // 2
    assert got.loss_sha256 == hashlib.sha256("".join(texts[1::2]).encode()).hexdigest()
    turns = [len(t) + (13 if k % 2 == 0 else 7) for k, t in enumerate(texts)]
    sums = [sum(turns[:2])]
    for k in range(2, n, 2):
        sums.append(sums[-1] + turns[k] + turns[k + 1])
    assert got.formatted_chars == sum(sums)


def test_near_duplicates(docs, none, rows):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {r.doc_id: r for r in minhash_near.near_duplicates(docs).collect()}
    assert {k: (len(s), top(k), top(k) == k) for k, s in sets.items()} == {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()}
    assert minhash_near.near_duplicates(none).count() == 0


def test_near_copies_stage_takes_five_words(spark):
    import corpus_pipeline

    base = ["w%d" % k for k in range(100)]
    changed = lambda *at: " ".join("x%d" % k if k in at else w for k, w in enumerate(base))
    rows = [(1, " ".join(base)), (2, changed(20, 40, 60)), (3, changed(50)), (4, "a b")]  # 1 and 2: 0.89 by two words, 0.73 by five
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in rows for w in [t.split()]}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert near == {(1, 3)} and sorted(r.doc_id for r in got) == [1, 2, 4]


def test_line_dedup_short_lines(spark):
    rows = [(1, "Yes\nno way\n\n--\nYes."), (2, "yes!\nmaybe\n--\n\nNo  way"), (3, "read all of it\nmaybe not"), (4, "Read all of it\nother")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {1: "Yes\nno way\n\n--", 2: "maybe\n--\n", 3: "read all of it\nmaybe not", 4: "other"}


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    clean = ["w%d" % i for i in range(400)]
    bad = ["awful%d" % i for i in range(6)]
    rows = []
    for k in range(1500):
        toxic = int(rng.random() < 0.15)
        ws = [rng.choice(clean) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 4) * toxic):
            ws.insert(rng.randrange(len(ws)), rng.choice(bad).upper() + "!")
        rows.append((k, " ".join(ws), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, "")], "doc_id long, text string").withColumn("severity_note", F.lit(1))
    labels = spark.createDataFrame([(k, 1, t) for k, _, t in rows[:1000]] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = rows[1000:]
    assert sum(got[k].toxic == bool(t) for k, _, t in held) >= 0.98 * len(held)
    assert not got[5000].toxic and not got[5001].toxic and all(0 <= r.severity <= 2 for r in got.values())
    assert not toxicity.toxicity(docs, labels.where("false")).where("toxic").count()


def test_fit_drops_only_copies_of_one_grade():
    rng = random.Random(4)
    draw = lambda n: np.array([rng.getrandbits(64) for _ in range(n)], "u8")
    common = draw(30)
    sets = [np.concatenate([common, draw(40)]) for _ in range(200)]
    sigs = [minhash_near.signature(s).tolist() for s in sets]
    grades = [k % 3 for k in range(200)]
    assert toxicity.without_copies([*sigs, None, None], [*grades, 0, 0]) == list(range(202))
    near = minhash_near.signature(np.concatenate([sets[0][:-2], draw(2)])).tolist()
    assert toxicity.without_copies([*sigs, near, near], [*grades, grades[0], 1]) == [*range(200), 201]


def test_cumulative_link_gradient_and_optimum():
    rng = np.random.default_rng(6)
    s, thetas, grades, weight = rng.normal(size=40), np.array([-0.3, 0.9]), rng.integers(0, 3, 40), rng.uniform(0.1, 1, 40)
    _, g_s, g_t = toxicity.losses(s, thetas, grades, weight)
    for g, x, at in ((g_s, s, lambda y: (y, thetas)), (g_t, thetas, lambda y: (s, y))):
        for k in range(len(x)):
            up, down = x.copy(), x.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            by_hand = (toxicity.losses(*at(up), grades, weight)[0] - toxicity.losses(*at(down), grades, weight)[0]) / 2e-5
            assert abs(by_hand - g[k]) < 1e-6
    # the fit against a search of all weights and thresholds on a grid that is made finer
    rows = [[k for k in range(2) if rng.random() < 0.5] for _ in range(80)]
    grades = np.array([min(2, int(len(r) * 0.9 + rng.random() * 1.2)) for r in rows])
    w, t = toxicity.fit_cumulative_link(rows, grades, 2, l2=0.0)
    x = np.array([[float(k in r) for k in range(2)] for r in rows])
    n_low = (grades == 0).sum()
    weight = np.where(grades == 0, 0.5 / n_low, 0.5 / (len(rows) - n_low))
    value = lambda p: toxicity.losses(x @ p[:2], np.array([p[2], p[2] + np.exp(p[3])]), grades, weight)[0]
    best, width = np.array([1.0, 1.0, 1.0, 0.0]), 3.0
    while width > 1e-4:
        options = [best] + [best + width * np.array(d) for d in np.ndindex(3, 3, 3, 3) for d in [np.array(d) - 1]]
        options = [p for p in options if (p[:2] >= 0).all()]
        new = min(options, key=value)
        if new is best or value(new) >= value(best) - 1e-12:
            width /= 2
        best = new
    assert value(np.array([*w, t[0], np.log(t[1] - t[0])])) <= value(best) + 1e-4


def test_toxicity_keeps_clashing_columns_where_asked(spark):
    docs = spark.createDataFrame([(1, "a", "mine"), (2, None, "mine")], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.severity for r in toxicity.judged(docs, labels).collect()} == {"mine"}
    assert {r.severity for r in toxicity.toxicity(docs, labels).collect()} == {0.0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_quality_rules(docs, none, rows):
    got = collections.Counter((r.doc_id, *r.stats, r.base_failed, r.kept) for r in quality_rules.quality_cascade(docs).collect())
    want = collections.Counter()
    for k, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {i + d for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for d in range(5)}
        n, chars, sym, dup = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
        failed = n < 10 or 100 * len(cover) > 20 * n
        kept = not (failed or 10 * sym > n or 2 * dup > len(lines) or chars > 15 * n or chars < 2 * n)
        kept &= 100 * sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines) <= 30 * len(lines)
        kept &= 100 * sum(x.lstrip(" \t\n\x0b\x0c\r")[0] in "•●*·‣–-" for x in lines) <= 90 * len(lines)
        kept &= 2 * sum(not any(c.isalpha() for c in x) for x in w) <= n
        kept &= 10 * sum(unicodedata.category(c) == "Lu" for c in t) <= 7 * sum(c.isalpha() for c in t)
        want[(k, n, chars, sym, len(lines), dup, len(cover), failed, kept)] += 1
    assert got == want
    assert quality_rules.quality_cascade(none).count() == 0


def test_rules_in_any_order_agree(docs):
    rules = quality_rules.base_rules() + quality_rules.further_rules()
    docs = quality_rules.with_stats(docs, "text", "s")
    both = docs.select(quality_rules.verdict(rules, F.col("text"), F.col("s")).isNull().alias("a"), quality_rules.verdict(rules[::-1], F.col("text"), F.col("s")).isNull().alias("b"))
    assert all(r.a == r.b for r in both.collect())
    whole = [r.doc_id for r in quality_rules.cascade(docs).select("doc_id", "__rejected_by").collect() if r["__rejected_by"] is None]
    kept = [r.doc_id for r in quality_rules.quality_cascade(docs.drop("s")).select("doc_id", "kept").collect() if r.kept]
    assert sorted(whole, key=str) == sorted(kept, key=str)


def test_cascade_skips_rules_and_keeps_its_order(docs):
    stats = quality_rules.with_stats(docs, "text", "__stats")
    names = [[r.name for r in quality_rules.order_rules(stats, quality_rules.further_rules())] for _ in range(3)]
    assert names[0] == names[1] == names[2]
    assert set(names[0][:4]) == {"symbols", "repeated_lines", "long_words", "short_words"}  # comparisons come first
    cheap = quality_rules.Rule("all", lambda t, s: t.isNotNull())
    fails = quality_rules.Rule("fails", lambda t, s: F.raise_error(F.concat(F.lit("evaluated"), F.left(t, F.lit(1)))).cast("boolean"))
    got = stats.select(quality_rules.verdict([cheap, fails], F.col("text"), F.col("__stats")).alias("v")).distinct().collect()
    assert [r.v for r in got] == ["all"]
    with pytest.raises(Exception, match="evaluated"):
        stats.select(quality_rules.verdict([fails, cheap], F.col("text"), F.col("__stats")).alias("v")).collect()


def test_rules_that_read_text_are_evaluated_for_rows_that_reach_them_only(spark):
    rows = [(1, "too few"), (2, " ".join(f"#{k}" for k in range(20))), (3, " ".join(f"plain{k}" for k in range(20)))]
    seen = quality_rules.Rule("seen", lambda t, s: F.when(~t.startswith("plain"), F.raise_error(F.lit("reached"))).otherwise(F.lit(False)).cast("boolean"), lambda t, s: F.lit(10**9))
    own = [quality_rules.further_rules()[0], seen]
    df = quality_rules.with_stats(spark.createDataFrame(rows, "doc_id long, text string"), "text", "s")
    got = df.select("doc_id", quality_rules.verdict(own, F.col("text"), F.col("s"), quality_rules.base_failed(F.col("s"))).alias("v")).collect()
    assert {r.doc_id: r.v for r in got} == {1: "base", 2: "symbols", 3: None}


def test_judged_keeps_all_columns(docs):
    clash = docs.withColumns({"kept": F.lit("mine"), "base_failed": F.lit("own")})
    got = quality_rules.judged(clash).select(*clash.columns, "__verdict.kept").collect()
    assert {(r[-2], r[-3]) for r in got} == {("own", "mine")}


def test_token_counts(docs, none, rows):
    scores, longest = token_counts.unigram_scores()

    def best(word):
        top = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(top[a][0] + scores[word[a:end]], -top[a][1] - 1) for a in range(max(0, end - longest), end) if word[a:end] in scores]
            s, n = max(options)
            top.append((s, -n))
        return top[-1][1]

    got = collections.Counter(map(tuple, token_counts.token_counts(docs).collect()))
    want = collections.Counter()
    for k, t in rows:
        pre = pretokens.pattern().findall(t or "")
        want[(k, len((t or "").encode()), len(pre), sum(best(p.encode()) for p in pre))] += 1
    assert got == want
    assert token_counts.token_counts(none).count() == 0


def test_pretokens_split_where_the_pattern_does():
    for text in ("", " ", "a", "a b", " a b", "a  b", "a \nb", "a\n b", "it's 5 o'clock, ok?", "x y z", "a b ", "\na b", "é— b1 2c", "a\x1cb c", "a \x1c b"):
        split = pretokens.split_words(text)
        if split is not None:
            first, rest = split
            assert [*pretokens.pattern().findall(first), *[p for w in rest for p in pretokens.pattern().findall(" " + w)]] == pretokens.pattern().findall(text)
        want = pretokens.full_tokenizer().encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.encode(text), "<u4").tolist() == want
