"""Turn repair beside a search over all edits, WARC archives beside the pages they were made of."""

import gzip
import hashlib
import os
import random
import re
import zlib
from itertools import product

import pytest

from caseloom.llm import turn_repair as T, warc

TURNS = "conv_id long, turn long, role string, text string, gone boolean, n long"


def cheapest(rows):
    """Every way to edit, by breadth over (row, letters so far); inserts at most two in a row."""
    best = {}
    start = [((0, ""), "", ())]
    layer = start
    grammar = re.compile(r"(s?(ua)+)?")
    alive = re.compile(r"(s?(ua)*u?)?")

    def inserted(states):
        out = dict()
        for (c, a), r, lines in states:
            for n in range(3):
                for roles in product(("user", "assistant"), repeat=n):
                    new = r + "".join(x[0] for x in roles)
                    if alive.fullmatch(new):
                        z = ((c + 5 * n, a + "I" * n), new, (*lines, *[f"{x}:" for x in roles]))
                        key = shape(new)
                        if key not in out or z[0] < out[key][0]:
                            out[key] = z
        return list(out.values())

    def shape(r):
        return "" if not r else r[-1]

    for role, text, must, cut in rows:
        layer = inserted(layer)
        new = {}
        for (c, a), r, lines in layer:
            ways = [((c + 2, a + "D"), r, lines)]
            if not must:
                x = 5 if cut else 0
                ways.append(((c + x, a + "K"), r + role[:1], (*lines, f"{role}:{text}")) if role else ((10**9, "K"), r, lines))
                ways += [((c + 1 + x, a + "R"), r + o[0], (*lines, f"{o}:{text}")) for o in ("user", "assistant")]
            for z in ways:
                if alive.fullmatch(z[1]) and (shape(z[1]) not in new or z[0] < new[shape(z[1])][0]):
                    new[shape(z[1])] = z
        layer = list(new.values())
    for z in inserted(layer):
        if grammar.fullmatch(z[1]) and (not best or z[0] < best["z"][0]):
            best["z"] = z
    return best["z"]


def brute(rows):
    convs = {}
    for conv, turn, role, text, gone, *_ in rows:
        own = convs.setdefault(conv, [])
        if not gone:
            own.append((turn, role, text))
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, edits, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            blank, again = not text.strip(" \t\n\x0b\x0c\r"), (role, text) in seen
            cut = not text.rstrip(" \t\n\x0b\x0c\r").endswith((".", "!", "?"))
            seen.add((role, text))
            counts[0 if blank else 1 if again else 2] += blank or again or cut
            edits.append((role, text, blank or again, cut))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        (cost, audit), _, lines = cheapest(edits)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def turns(seed=5):
    rnd = random.Random(seed)
    say = lambda: rnd.choice(["Yes.", "No", "", " ", "Why?", "ok. \n", "é!", f"t{rnd.randint(0, 9)}."])
    rows = []
    for conv in [*range(60), None, 900, 901]:
        n = 700 if conv == 900 else rnd.randint(1, 9)
        for t in range(n):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " "])
            rows.append((conv, None if rnd.random() < 0.05 else t + rnd.choice((0, 0, 2**53)) * (conv == 3), role, say(), False, 1))
            if rnd.random() < 0.1:
                rows.append(rows[-1])
    return rows + [(77, 5, "user", "x", True, 0), (78, 5, "user", "x", True, 0), (78, 6, "user", "Hi.", False, 0)]


@pytest.mark.parametrize("block,fan", [(1024, 64), (7, 3)])
def test_repair_is_cheapest(spark, monkeypatch, block, fan):
    monkeypatch.setattr(T, "BLOCK_TURNS", block)
    monkeypatch.setattr(T, "FAN", fan)
    rows = turns()
    out = T.repair_turns(spark.createDataFrame(rows, TURNS).repartition(3))
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)


def test_repair_of_long_texts_and_empty_tables(spark):
    assert T.repair_turns(spark.createDataFrame([], TURNS)).collect() == []
    rows = [(1, 0, "user", "word " * 20_000 + ".", False, 0), (1, 1, "assistant", "x" * 100_000 + "!", False, 0)]
    assert sorted(map(tuple, T.repair_turns(spark.createDataFrame(rows, TURNS)).collect())) == brute(rows)


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. b!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = {}
    for r in T.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.gone))
    text = lambda x: " " if x is None else str(x)
    for c, t, role, said in rows:
        kind = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20
        one = ("user" if kind == 4 else text(role), "" if kind == 1 else re.sub("[.!?]", "", text(said)) if kind == 2 else text(said), kind == 0)
        assert got[c, t] == [one] * (2 if kind == 3 else 1)


def test_matrices_multiply_in_any_order():
    rnd = random.Random(2)
    for _ in range(200):
        ms = [T.turn_matrix(rnd.choice("suax"), rnd.choice((T.SOUND, T.CUT_OFF, T.GONE))) for _ in range(rnd.randint(1, 9))]
        left = ms[0]
        for m in ms[1:]:
            left = T.times(left, m)
        assert left == T.tree(ms)


PAGES = "page_id long, url string, html string, payload string, digest int"


def pages(n=400, seed=1):
    rnd = random.Random(seed)
    copies = ["é" * 600, "c" * 999, "c" * 1000, "<p>" + "x" * 3000]
    rows = [(k * 7, f"http://a.b/{k}" if k % 5 else None, rnd.choice(copies) if k % 3 == 0 else f"<p>{'y' * rnd.randint(0, 3000)}{k}</p>", "p", k) for k in range(n)]
    rows += [(5_000, "u r\nl\t", None, None, None), (5_001, " http://x ", "", "", 0), (None, "n", copies[3], "", 0), (None, "n", "z" * 2000, "", 0), (None, "m", "z" * 2000, "", 0)]
    return rows + [(6_000, "long", "long " * 200_000, "", 0), (7_000, "twice", "q" * 1500, "", 0), (7_000, "twice", "q" * 1500, "", 0)]


def expected(rows):
    groups = {}
    for p, _, h, *_ in rows:
        groups.setdefault((h or "").encode(), []).append(p)
    out = []
    for body, ids in groups.items():
        ids.sort(key=lambda p: (p is not None, p or 0))
        stored = len(body) < 1000
        for k, p in enumerate(ids):
            kept = stored or k == ids.index(ids[-1])
            out.append((p, len(body), hashlib.sha1(body).hexdigest(), "response" if kept else "revisit", None if kept else ids[-1]))
    return sorted(out, key=repr)


def test_archives_hold_the_pages(spark, tmp_path):
    rows, where = pages(), f"file://{tmp_path}/a"
    warc.write_archives(spark.createDataFrame(rows, PAGES), where, shard_bytes=60_000, file_bytes=8_000)
    back = warc.read_archives(spark, where).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr) == expected(rows)
    assert sorted(((r.page_id, r.url) for r in back), key=repr) == sorted(((p, u) for p, u, *_ in rows), key=repr)
    bodies = {r.payload_digest: bytes(r.payload) for r in back if r.record_type == "response"}
    assert {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h, *_ in rows} == bodies
    files = sorted(f for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))
    assert len(files) > 8 and not os.path.exists(tmp_path / "a/_temporary")
    raw = b"".join(gzip.open(tmp_path / "a" / f).read() for f in files)
    assert raw.count(b"WARC/1.1\r\n") == len(rows)
    ids = [r for f in files for r in re.findall(rb"WARC-Record-ID: <urn:page:(\d*):", gzip.open(tmp_path / "a" / f).read())]
    assert [int(i or -1) for i in ids] == sorted(int(i or -1) for i in ids)


def test_same_rows_give_the_same_files(spark, tmp_path):
    rows = pages(200)
    for name, parts, order in (("a", 1, 1), ("b", 5, -1)):
        warc.write_archives(spark.createDataFrame(rows[::order], PAGES).repartition(parts), f"{tmp_path}/{name}", 50_000, 9_000)
    a, b = ({f: (tmp_path / d / f).read_bytes() for f in os.listdir(tmp_path / d) if f.endswith(".gz")} for d in "ab")
    assert a == b and len(a) > 4


def test_only_the_manifest_counts(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(pages(30), PAGES), str(tmp_path))
    (tmp_path / "pages-00000-00099.warc.gz").write_bytes(b"lost attempt")
    n = warc.read_archives(spark, str(tmp_path)).count()
    file = next(f for f in os.listdir(tmp_path) if f.endswith(".gz") and "99" not in f)
    data = (tmp_path / file).read_bytes()
    assert n == len(pages(30))
    (tmp_path / file).write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="record"):
        warc.read_archives(spark, str(tmp_path)).count()
    warc.write_archives(spark.createDataFrame(pages(30), PAGES), str(tmp_path))
    assert warc.read_archives(spark, str(tmp_path)).count() == n


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path))
    assert warc.read_archives(spark, str(tmp_path)).collect() == []
