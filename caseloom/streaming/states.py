"""Rules with a memory of their own for each key, on streams: lock-outs and learned questions.

Both keep their state in the stream's state store (RocksDB: set `ROCKS` on the session), so a restart goes on where the
last checkpoint stopped. Events may come late and out of order by up to the watermark's delay: they wait in a list
state, and a timer plays them in the order of their time once the watermark has passed them, which gives what the
batch operators give on the whole table. A key's state is a number, or at most KEPT questions, and what waits for the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
# Failures that lock, minutes of the first lock, questions that a bank keeps, least characters of one.
EVERY, MINUTES, KEPT, SHORTEST = 5, 5, 40, 6


class InOrder(StatefulProcessor):
    """Plays a key's events by (ts, event_id) once the watermark has passed them; `play` gets them and says what comes of them."""

    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        for pdf in rows:
            new += [tuple(r) for r in pdf[self.columns].itertuples(index=False)]
        self.waiting.appendList([self.plain(r) for r in new])
        for at in sorted({int(r[0].value // 1_000_000) for r in new}):
            self.handle.registerTimer(at + 1)
        yield from ()

    @staticmethod
    def plain(row: tuple) -> tuple:
        return (int(row[0].value // 1_000), *(x.item() if hasattr(x, "item") else x for x in row[1:]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()]
        due = sorted(r for r in held if r[0] < upto)
        self.waiting.clear()
        if len(due) < len(held):
            self.waiting.put([r for r in held if r[0] >= upto])
        out = self.play(key, due)
        if len(out):
            yield out


class Lockouts(InOrder):
    """State of a key: failures since the last success. Every EVERY-th locks, each time for twice as long."""

    columns = ["ts", "event_id", "failed", "cleared"]
    waiting_schema = "ts long, event_id long, failed boolean, cleared boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.failures = handle.getValueState("failures", "n long")

    def play(self, key, due: list[tuple]) -> pd.DataFrame:
        n, out = self.failures.get()[0] if self.failures.exists() else 0, []
        for _, event_id, failed, cleared in due:
            n = 0 if cleared else n
            if failed:
                n += 1
                if n % EVERY == 0:
                    out.append((key[0], event_id, MINUTES * 2 ** min(n // EVERY - 1, 40)))
        self.failures.update((n,))
        return pd.DataFrame(out, columns=["key", "event_id", "minutes"])


class Learned(InOrder):
    """State of a bank: how often each question was used and when last; of more than KEPT the least used, then oldest, goes."""

    columns = ["ts", "event_id", "text"]
    waiting_schema = "ts long, event_id long, text string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.bank = handle.getMapState("bank", "question string", "text string, n long, at long")

    def play(self, key, due: list[tuple]) -> pd.DataFrame:
        own = {q[0]: tuple(v) for q, v in self.bank.iterator()} if self.bank.exists() else {}
        changed = {}
        for ts, _, text in due:
            text = " ".join((text or "").split())
            if len(text) < SHORTEST:
                continue
            q = text.lower()
            first, n, _ = own.get(q, (text, 0, 0))
            own[q] = changed[q] = (first, n + 1, ts)
            if len(own) > KEPT:
                gone = min(own, key=lambda x: (own[x][1], own[x][2], x))
                del own[gone]
                changed[gone] = None
        for q, v in changed.items():
            if v is None:
                self.bank.removeKey((q,))
            else:
                self.bank.updateValue((q,), own[q])
        rows = [(key[0], q, *(v or (None, 0, None))[:2]) for q, v in changed.items()]
        return pd.DataFrame(rows, columns=["key", "question", "text", "n"]).astype({"n": "int64"})


def lockout_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(key, event_id, minutes) of a stream (key, ts, event_id, failed, cleared)."""
    keyed = events.withWatermark("ts", late).groupBy(F.col("key"))
    kind = events.schema["key"].dataType.simpleString()
    return keyed.transformWithStateInPandas(Lockouts(), f"key {kind}, event_id long, minutes long", "Append", "EventTime")


def learned_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(key, question, text, n) of a stream (key, ts, event_id, text): each change of a bank, n = 0 where a question is
    forgotten; a question's last row is what the bank holds of it."""
    keyed = events.withWatermark("ts", late).groupBy(F.col("key"))
    kind = events.schema["key"].dataType.simpleString()
    return keyed.transformWithStateInPandas(Learned(), f"key {kind}, question string, text string, n long", "Append", "EventTime")
