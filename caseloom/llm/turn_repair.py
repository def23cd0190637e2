"""Conversation structure repair by a min-plus matrix scan.

Roles should read `(s?(ua)+)?` (initials of system, user, assistant). An automaton of four states
(nothing yet, after system, after user, after assistant) says so, and each turn is a 4x4
matrix over it: the entry (i, j) is the cheapest edit of that turn which leads from state i
to j, as (cost, audit), times the closure of insertions, which may follow any turn. Sums of
costs with joined audits, and the least of (cost, audit), form a semiring: of one run of turns no
audit is the beginning of another of equal cost, so comparing audits commutes with joining
them. The product of all matrices therefore needs no order of evaluation.

Turns are sorted by range over (conv_id, turn, role), so a long conversation lies in several tasks.
A task reduces the matrices of each conversation in a balanced tree. One that begins and ends
inside the task is finished there; those at the edges, and ones of more than BLOCK_TURNS turns or
BLOCK_CHARS characters, become blocks, each with its matrix, and blocks are reduced FAN at a time
by (conversation, task, block), level by level, until one matrix is left. The states at the limits of blocks travel
with the elements, so each block is then edited on its own.
SHA-256 is sequential by definition: the edited texts of a conversation in blocks pass one task in
order, as a stream.

Edits: Keep costs 0, Rerole (to user or assistant) 1, Delete 2 (required for blank and duplicate
turns), Insert (an empty user or assistant turn) 5; a truncated turn that stays costs 5 more.

Defined results: null conv_ids are one conversation; a null role or text counts as one space; turns
are ordered by (turn, role, text), nulls first, so repeated rows are adjacent and all but the
first are duplicates; the empty role has no initial; conversations without turns have zeros, no audit
and the hash of the empty text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from caseloom.session import materialize

START, SYSTEM, USER, ASSISTANT = range(4)
# Initials of roles, costs of the edits.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
#: The turn that may follow in each state.
NEXT = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
BLOCK_TURNS, BLOCK_CHARS, FAN = 1024, 4_000_000, 64
SOUND, CUT_OFF, GONE = range(3)  # what a turn's fault asks for: nothing, the extra cost, deletion
INK, END = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")

Element = tuple[int, str]
Matrix = list[list[Element | None]]


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product: costs add, audits join, the least (cost, audit) stays."""
    out = []
    for row in a:
        best: list[Element | None] = [None] * 4
        for x, through in zip(row, b, strict=True):
            if x is not None:
                for j, y in enumerate(through):
                    if y is not None and (best[j] is None or (x[0] + y[0], x[1] + y[1]) < best[j]):
                        best[j] = (x[0] + y[0], x[1] + y[1])
        out.append(best)
    return out


def tree(matrices: list[Matrix]) -> Matrix:
    """Product of one matrix or more, reduced pairwise."""
    while len(matrices) > 1:
        odd = matrices[len(matrices) & ~1 :]
        matrices = [times(a, b) for a, b in zip(matrices[::2], matrices[1::2])] + odd  # noqa: B905
    return matrices[0]


def empty() -> Matrix:
    return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


@cache
def closure() -> Matrix:
    """Any number of insertions; three lead from any state to any that can be reached."""
    step = empty()
    for state, role in NEXT.items():
        step[state][USER if role == "user" else ASSISTANT] = (INSERT, "I")
    return times(times(step, step), step)


@cache
def turn_matrix(initial: str, fault: int) -> Matrix:
    one: Matrix = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if fault != GONE:
        extra = CUT if fault == CUT_OFF else 0
        if initial == "s":
            one[START][SYSTEM] = (KEEP + extra, "K")
        for state, role in NEXT.items():
            kept = role[0] == initial
            one[state][USER if role == "user" else ASSISTANT] = (KEEP + extra, "K") if kept else (REROLE + extra, "R")
    return times(one, closure())


def edited(state: int, audit: str, roles: list[str], texts: list[str]) -> list[str]:
    """The lines `role:text` that the audit leaves of a run of turns."""
    out, k = [], 0
    for edit in audit:
        if edit != "D":
            role = roles[k] if edit == "K" else NEXT[state]
            out.append(f"{role}:{'' if edit == 'I' else texts[k]}")
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        k += edit != "I"
    return out


def best_path(m: Matrix) -> tuple[Element, int, int]:
    """The cheapest way from the start to an end that is allowed: (cost, audit), and the states before and after m."""
    ways = [((c[0] + x[0], c[1] + x[1]), s, j) for s, c in enumerate(closure()[START]) if c for j in (START, ASSISTANT) if (x := m[s][j])]
    return min(ways)


def damage(conversations: DataFrame) -> DataFrame:
    """Damaged copies of all turns by crc32(conv_id:turn) % 20: 0 drops the turn (its row stays, marked
    `gone`), 1 empties its text, 2 removes . ! ?, 3 repeats it, 4 makes it a user's."""
    space = F.lit(" ")
    of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(of("text"), "[.!?]", "")).otherwise(of("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(of("role")).alias("role"),
        text.alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
    ).drop("__copy")


def with_repeats(turns: DataFrame) -> DataFrame:
    """Adds `later`: whether a turn of a lower number says the same in the same role. Turns that nothing
    repeats are found by counts, and only repeated ones are joined."""
    said = turns.withColumn("__h", F.unhex(F.sha2(F.concat_ws(":", F.char_length("role"), "role", "text"), 256)))
    first = said.where("not gone").groupBy(F.col("conv_id").alias("__c"), F.col("__h").alias("__k")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("turn").alias("__first"), F.bool_or(F.col("turn").isNull()).alias("__null")
    ).where("__n > 1")
    later: Column = F.coalesce(F.col("turn").isNotNull() & (F.col("__null") | (F.col("turn") > F.col("__first"))), F.lit(False))
    joined = said.join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__h") == F.col("__k")), "left")
    return joined.select("conv_id", "turn", "role", "text", "gone", later.alias("later"))


COUNTS = ("n", "blank", "duplicate", "truncated", "illegal")
STATS = "n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
STAT_NAMES = [s.split()[0] for s in STATS.split(", ")]


def merged(a: dict, b: dict) -> dict:
    """Figures of two neighbouring runs of turns as those of one."""
    if not a["n"] or not b["n"]:
        return a if a["n"] else b
    out = {c: a[c] + b[c] for c in COUNTS}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    shared = a["high"] is not None and a["high"] == b["low"]
    bounds = [x for x in (a["low"], b["low"], a["high"], b["high"]) if x is not None]
    return out | {"first": a["first"], "last": b["last"], "low": min(bounds, default=None), "high": max(bounds, default=None), "turns": a["turns"] + b["turns"] - shared}


class Run:
    """Turns of one conversation, in order, as far as they are held."""

    def __init__(self):
        self.roles, self.texts, self.faults, self.chars = [], [], [], 0
        self.stats = dict.fromkeys(STAT_NAMES, 0) | {"first": None, "last": None, "low": None, "high": None}

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        blank = not INK.search(text)
        cut = not blank and not repeated and not END.search(text)
        one = {"n": 1, "blank": int(blank), "duplicate": int(repeated and not blank), "truncated": int(cut), "illegal": 0, "first": role[:1], "last": role[:1], "low": turn, "high": turn, "turns": int(turn is not None)}
        self.stats = merged(self.stats, one)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(GONE if blank or repeated else CUT_OFF if cut else SOUND)
        self.chars += len(text)

    def matrix(self) -> Matrix:
        return tree([turn_matrix(r[:1], f) for r, f in zip(self.roles, self.faults, strict=True)] or [closure()])


def sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def cells(m: list[list[tuple | None]], part: int) -> list:
    """One part (0 cost, 1 audit, 2 limits) of the 16 entries, row by row."""
    return [x and x[part] for row in m for x in row]


def matrix_of(*parts: list) -> list[list[tuple | None]]:
    """The matrix whose entries' parts these are."""
    entries = [None if x[0] is None else x for x in zip(*parts, strict=True)]
    return [entries[k : k + 4] for k in range(0, 16, 4)]


RUNS = f"conv_id CONV, whole boolean, id long, part int, block int, {STATS}, cost long, audit string, sha string, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
STATE = f"conv_id CONV, part int, block int, {STATS}, costs array<long>, audits array<string>, limits array<string>, ids array<long>"
ROOTS = f"conv_id CONV, {STATS}, cost long, audit string, steps array<struct<id: long, lead: string, a: int, b: int>>"
LINES = "conv_id CONV, id long, lines array<string>"
SHAS = "conv_id CONV, sha string"


def both(schema: str, kinds: StructType) -> tuple[str, pa.Schema]:
    """The schema, for Spark and for Arrow, with the type that conv_id has in the input."""
    ddl = schema.replace("CONV", kinds["conv_id"].dataType.simpleString())
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def scan(turns: DataFrame) -> DataFrame:
    """One finished row per conversation that lies within a task, and the blocks of the others."""
    ddl, types = both(RUNS, turns.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        out, at, held, before = [], None, None, None
        edge = True  # what is held began in the task's first conversation, or part of it is out already

        def finished() -> dict:
            (cost, audit), *_ = best_path(held.matrix())
            return held.stats | {"conv_id": at, "whole": True, "cost": cost, "audit": audit, "sha": sha(edited(START, audit, held.roles, held.texts))}

        def as_block() -> dict:
            m = held.matrix()
            return held.stats | {"conv_id": at, "whole": False, "id": (part << 32) + block, "part": part, "block": block, "costs": cells(m, 0), "audits": cells(m, 1), "roles": held.roles, "texts": held.texts}

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "later")]
            for conv, turn, role, text, gone, later in zip(*columns, strict=True):
                if held and (conv != at or len(held.roles) >= BLOCK_TURNS or held.chars >= BLOCK_CHARS):
                    edge |= conv == at
                    out.append(as_block() if edge else finished())
                    block += edge
                    if edge or len(out) >= 500:
                        yield pa.RecordBatch.from_pylist(out, schema=types)
                        out = []
                    if conv != at:
                        edge, before = False, None
                    held = None
                held, at = held or Run(), conv
                if not gone:
                    held.add(turn, role, text, later or before == (turn, role, text))
                    before = (turn, role, text)
        if held:
            out.append(as_block())  # the conversation may go on in the next task
        yield pa.RecordBatch.from_pylist(out, schema=types)

    rows = turns.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialize(rows.mapInArrow(run, ddl), "turn-runs")


def times_with_limits(a: list, b: list) -> list:
    """`times` for (cost, audit, limits): limits, one digit each, are the states between blocks."""
    out = []
    for row in a:
        best: list = [None] * 4
        for s, x in enumerate(row):
            for j, y in enumerate(b[s]):
                if x is not None and y is not None:
                    z = (x[0] + y[0], x[1] + y[1], f"{x[2]}{s}{y[2]}")
                    if best[j] is None or z < best[j]:
                        best[j] = z
        out.append(best)
    return out


def reduced(state: DataFrame, by: list[Column]) -> DataFrame:
    """One row for each group of at most some FAN neighbouring blocks: their product."""
    ddl, types = both(STATE, state.schema)

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["block"]))
        one = rows[0] | {"ids": [i for r in rows for i in r["ids"]]}
        m = matrix_of(one["costs"], one["audits"], one["limits"])
        for r in rows[1:]:
            m = times_with_limits(m, matrix_of(r["costs"], r["audits"], r["limits"]))
            one |= {c: merged(one, r)[c] for c in STAT_NAMES}
        one |= {"costs": cells(m, 0), "audits": cells(m, 1), "limits": cells(m, 2)}
        return pa.Table.from_pylist([one], schema=types)

    return materialize(state.groupBy(*by).applyInArrow(run, ddl), "turn-blocks")


def to_one_block(state: DataFrame) -> DataFrame:
    """Levels of the tree across tasks: blocks of a task first, then tasks, FAN at a time."""
    conv, part, block = F.col("conv_id"), F.col("part"), F.col("block")
    blocks, parts = state.agg(F.coalesce(F.max("block"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0))).first()
    levels = [[conv, part, F.floor(block / FAN**k)] for k in range(1, 12) if FAN ** (k - 1) <= blocks]
    levels += [[conv, F.floor(part / FAN**k)] for k in range(1, 7) if FAN ** (k - 1) <= parts]
    for by in levels:
        most = state.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
        if most <= FAN:
            return reduced(state, [conv]) if most > 1 else state
        state = reduced(state, by)
    return state


def repair_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of turns
    (conv_id, turn, role, text, gone): rows marked gone only stand for their conversation."""
    runs = scan(with_repeats(turns))
    (roots_ddl, roots_types), (lines_ddl, lines_types), (shas_ddl, shas_types) = (both(s, runs.schema) for s in (ROOTS, LINES, SHAS))
    blocks = runs.where("not whole")
    none = F.array_repeat(F.lit(""), 16).alias("limits")
    state = to_one_block(blocks.select("conv_id", "part", "block", *STAT_NAMES, "costs", "audits", none, F.array("id").alias("ids")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                (cost, audit), s, j = best_path(matrix_of(r["costs"], r["audits"]))
                states = [s, *map(int, r["limits"][4 * s + j]), j]
                lead = [closure()[START][s][1]] + [""] * len(r["ids"])
                steps = [{"id": i, "lead": le, "a": a, "b": b} for i, le, a, b in zip(r["ids"], lead, states, states[1:])]  # noqa: B905
                own = {c: r[c] for c in ("conv_id", *STAT_NAMES)}
                out.append(own | {"cost": cost, "audit": audit, "steps": steps})
            yield pa.RecordBatch.from_pylist(out, schema=roots_types)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lines = edited(START, r["lead"], [], []) + edited(r["a"], r["own"], r["roles"], r["texts"])
                yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "id": r["id"], "lines": lines}], schema=lines_types)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h, fresh = None, None, True
        for batch in batches:
            for r in batch.to_pylist():
                if h and r["conv_id"] != at:
                    yield pa.RecordBatch.from_pylist([{"conv_id": at, "sha": h.hexdigest()}], schema=shas_types)
                    h = None
                if h is None:
                    at, h, fresh = r["conv_id"], hashlib.sha256(), True
                for line in r["lines"]:
                    h.update((line if fresh else "\n" + line).encode())
                    fresh = False
        if h:
            yield pa.RecordBatch.from_pylist([{"conv_id": at, "sha": h.hexdigest()}], schema=shas_types)

    roots = materialize(state.mapInArrow(finish, roots_ddl), "turn-roots")
    plan = roots.select(F.explode("steps").alias("s")).select("s.*")
    todo = blocks.select("conv_id", "id", "roles", "texts", "audits").join(plan, "id")
    todo = todo.withColumn("own", F.get("audits", 4 * F.col("a") + F.col("b"))).drop("audits")
    lines = todo.mapInArrow(rewrite, lines_ddl)
    shas = lines.repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInArrow(digest, shas_ddl).withColumnRenamed("conv_id", "__c")
    cut = roots.join(shas, F.col("conv_id").eqNullSafe(F.col("__c")))
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(F.lit(0)).cast("long").alias("gaps")
    columns = ["conv_id", gaps, *COUNTS[1:], "cost", "audit", F.col("sha").alias("repaired_sha256")]
    return runs.where("whole").select(*columns).unionByName(cut.select(*columns))
