"""Each stage of the corpus pipeline against brute force on what the stage before kept."""

import collections
import random

from caseloom.llm import minhash_near, packing, pretokens
from tests.llm.test_groups import shingled, tops
from tests.llm.test_lines import brute, word

EXTRA = {"severity": "s", "grade": "g", "toxic": "t", "drop": "d", "kept": "k", "stats": "x", "n_removed": "r", "n_lines": "l", "id": "i", "key": "y", "item_id": "m", "sequence_id": "q"}


def corpus():
    rng = random.Random(21)
    rows, toxic = [], set()
    footer = "all rights reserved by the writers of this page and their friends"
    passage = " ".join(word(rng) for _ in range(40))
    for k in range(160):
        lines = [" ".join(word(rng) for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(1, 3))]
        if k % 9 == 0:
            lines.append(footer)
        if k % 5 == 0:
            lines[0] += " " + " ".join(rng.choice(("vileword", "awfulword", "hatefulword")) for _ in range(4))
            toxic.add(k)
        if k in (7, 32, 91):
            lines[0] = passage[: len(passage) // 2] + " " + lines[0]
        rows.append((k, "\n".join(lines)))
    for k, source in ((200, 11), (201, 11), (202, 13), (203, 16)):  # near copies on one line, exact copies
        ws = rows[source][1].replace("\n", " ").split(" ")
        ws[len(ws) // 2] = word(rng)
        rows.append((k, " ".join(ws)))
    rows += [(210, None), (211, ""), (212, rows[14][1]), (213, " ".join(word(rng) for _ in range(20_000))), rows[17], (214, "\n\n--\n")]
    return rows, toxic, passage[: len(passage) // 2]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, toxic, item = corpus()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), *EXTRA.values()) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k, _ in rows[:130]] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]

    def step(name, own):
        frame = spark.createDataFrame([(k, t, "en", "s", len(t or ""), *EXTRA.values()) for k, t in own], docs.schema).repartition(3)
        out = stages[name](spark, frame, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert {tuple(r[c] for c in EXTRA) for r in got} <= {tuple(EXTRA.values())}
        assert stages[name](spark, docs.where("false"), str(tmp_path)).count() == 0
        return collections.Counter((r.doc_id, r.text) for r in got), got

    one, _ = step("toxicity", rows)
    assert one == collections.Counter(r for r in rows if r[0] not in toxic)
    own = list(one.elements())

    two, got = step("line dedup", own)
    drop, _, _ = brute(spark, [r for r in own if r[0] != 213])
    assert two == collections.Counter((k, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop[k])) for k, t in own)
    assert all(r.n_chars == len(r.text or "") for r in got) and sum(map(bool, drop.values())) > 5
    own = list(two.elements())

    three, _ = step("MinHash near-dedup", own)
    sets = {k: shingled(t or "", 5) for k, t in own}
    top = tops(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert three == collections.Counter(r for r in own if top[r[0]] == r[0]) and len(three) < len(two)
    own = list(three.elements())

    four, _ = step("benchmark decontamination", own)
    assert four == collections.Counter(r for r in own if item not in (r[1] or "")) and len(four) < len(three)

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = pretokens.full_tokenizer()
    want = {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in four}
    sizes, bins = collections.Counter(), collections.defaultdict(list)
    for r in pieces:
        sizes[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    copies = collections.Counter(k for k, _ in four.elements())
    assert sizes == {k: n * copies[k] for k, n in want.items()}
    assert all(sum(n for _, n in b) <= 1024 and sorted(b)[0][0] == 0 for b in bins.values())


def test_workers_remember_nothing_between_tasks(spark):
    """Workers outlive a task: words that one remembers are memory that the steps after it lack."""
    docs = spark.createDataFrame([(i, f"some words alone {i} and more of them {i + 7}") for i in range(40)], "doc_id long, text string")

    def held(batches):
        import sys

        import pandas as pd

        for b in batches:
            own = [len(m._memory) for n in ("packing", "minhash_near") if (m := sys.modules.get(f"caseloom.llm.{n}"))]
            yield pd.DataFrame({"n": [sum(own)] * len(b)})

    assert packing.tokenize(docs).count() == 40 and minhash_near.profiles(docs).where("n_shingles > 0").count() == 40
    packing.tokenize(docs).write.format("noop").mode("overwrite").save()
    minhash_near.profiles(docs).write.format("noop").mode("overwrite").save()
    assert {r.n for r in docs.select("doc_id").mapInPandas(held, "n long").collect()} == {0}
