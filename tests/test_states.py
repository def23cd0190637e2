"""Streams in three micro-batches, out of order, with a restart between them, beside the batch operators."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import tracking as K
from caseloom.streaming import states


@pytest.fixture
def rocks(spark):
    for k, v in states.ROCKS.items():
        spark.conf.set(k, v)
    yield spark
    for k in states.ROCKS:
        spark.conf.unset(k)


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def played(spark, tmp_path, parts, schema, make):
    """Results of a query that is started anew for each part."""
    src, n = tmp_path / "in", 0
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = make(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        n += 1
    assert n == len(parts) and os.path.isdir(tmp_path / "cp/state")
    return spark.read.parquet(str(tmp_path / "out"))


def test_lockouts_on_a_stream(rocks, tmp_path):
    rnd = random.Random(2)
    events = [(k % 4, at(k * 20), k, (x := rnd.random()) < 0.8, x > 0.95) for k in range(400)]
    parts = []
    for lo, hi in ((0, 140), (140, 270), (270, 400)):
        part = events[lo:hi]
        rnd.shuffle(part)
        parts.append(part)
    parts[0][5], parts[1][7] = parts[1][7], parts[0][5]  # may be late, but not by more than the delay
    late = [e for e in parts[1] if e[2] < 140]
    parts[0] += late
    parts[1] = [e for e in parts[1] if e[2] >= 140]
    closing = [(99, at(10**6), 10**6, False, False)]
    schema = "key long, ts timestamp, event_id long, failed boolean, cleared boolean"
    got = played(rocks, tmp_path, [*parts, closing], schema, lambda s: states.lockout_stream(s, "2 hours"))
    batch = K.lockouts(rocks.createDataFrame(events, schema), "key", ["ts", "event_id"], F.col("failed"), F.col("cleared"))
    want = sorted((r.key, r.event_id, r.minutes) for r in batch.select("key", "event_id", "minutes").collect())
    assert sorted((r.key, r.event_id, r.minutes) for r in got.collect()) == want and len(want) > 20


def test_learned_questions_on_a_stream(rocks, tmp_path):
    rnd = random.Random(3)
    events = [(k % 2, at(k), k, rnd.choice([f"Question  number {min(int(rnd.expovariate(0.04)), 90)}?", "no", None, f"QUESTION number {rnd.randint(0, 9)}? "])) for k in range(900)]
    schema = "key long, ts timestamp, event_id long, text string"
    parts = [events[:300], events[300:600][::-1], events[600:], [(9, at(10**6), 10**6, "no")]]
    out = played(rocks, tmp_path, parts, schema, lambda s: states.learned_stream(s, "1 hour"))
    bank = {}
    for key, ts, _, text in events:
        text = " ".join((text or "").split())
        if len(text) >= 6:
            own = bank.setdefault(key, {})
            own[text.lower()] = (own.get(text.lower(), (0, 0))[0] + 1, ts)
            if len(own) > 40:
                del own[min(own, key=lambda q: (*own[q], q))]
    final = {}
    for r in out.collect():
        final.setdefault((r.key, r.question), []).append(r.n)
    held = {k: max(ns) for k, ns in final.items()}
    assert all(held.get((key, q), 0) >= n for key, own in bank.items() for q, (n, _) in own.items())
    assert {len(own) for own in bank.values()} == {40}
