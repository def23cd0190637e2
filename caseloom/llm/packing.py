"""Best-fit packing by minimum bin slack.

1. Each document is tokenised where it lies (one scan) into pieces of at most
   `capacity` ids; longer documents are cut from the end, so that only their first
   piece can be shorter. The pieces, without their texts, go to the shared folder.
2. Packing depends on the histogram of piece lengths alone, which has `capacity`
   entries at most, whatever the size of the corpus. The driver solves it: the largest
   length left opens a bin, a bitset subset-sum over the lengths left finds the fullest
   feasible combination with it, and this pattern is applied as often as the counts
   allow. Each step exhausts a length, so steps are bounded by the lengths, too. The search is made
   for a few slacks (bins that may be a little less full but take fewer pieces), and the fewest bins are kept.
3. Pieces get a rank within their length: counts per (length, salt), a running sum over
   those, and a row number within (length, salt). No length, however frequent, meets
   in one task. A rank and the pattern table (bounded by the histogram) give the
   sequence and the offset.

Defined results: null and empty texts give one piece with the end id only; repeated
rows are packed each for itself; an empty table gives an empty result; other columns
of the input are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from caseloom.llm import pretokens
from caseloom.session import materialize, tidy

CAPACITY = 1024
END_ID = 2
SLACKS = (0, 2, 8)  # how much less than the fullest a bin may hold, so that it takes fewer pieces
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_memory: dict[str, bytes] = {}


def forget() -> None:
    _memory.clear()


def encode(text: str | None) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers, special tokens not added."""
    if not text:
        return b""
    if pretokens.SPECIAL in text:
        ids = pretokens.full_tokenizer().encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()
    ordinary = pretokens.bpe().encode_ordinary
    first, *rest = text.split(" ")
    try:  # words are only remembered where they stand alone
        tail = b"".join(map(_memory.__getitem__, rest))
    except KeyError:
        if pretokens.split_words(text) is None:
            return np.array(ordinary(text), "<u4").tobytes()
        if len(_memory) > pretokens.MEMORY:
            _memory.clear()
        for w in rest:
            if w not in _memory:
                _memory[w] = np.array(ordinary(" " + w), "<u4").tobytes()
        tail = b"".join(map(_memory.__getitem__, rest))
    if first[-1:].isspace():
        return np.array(ordinary(text), "<u4").tobytes()
    return np.array(ordinary(first), "<u4").tobytes() + tail


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, bytes]]:
    """(start, ids) of each piece; only the first can be shorter than the capacity."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, ids[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]


def tokenize(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of documents (doc_id, text); with_ids adds the ids as binary `ids`."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                rows = []
                for doc, text in zip(pdf["doc_id"].iloc[at : at + 500], pdf["text"].iloc[at : at + 500], strict=True):
                    for k, (start, ids) in enumerate(cut(encode(text) + end, capacity)):
                        rows.append((doc, k, start, len(ids) // 4, zlib.crc32(ids), *[ids] * with_ids))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return docs.select("doc_id", "text").mapInPandas(tidy(run, forget), PIECES + ", ids binary" * with_ids)


def fullest(room: int, counts: dict[int, int], slack: int = 0) -> list[int]:
    """The lengths whose sum comes nearest to room, as a bitset subset-sum: bit s of a
    row is set if s can be reached with the lengths so far. Walking back from the
    largest length takes large ones first and leaves small ones for later bins. With a slack, sums of
    up to so much less are tried too, and that of the fewest lengths is taken (of equally many, the fullest)."""
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length in sorted(x for x in counts if x <= room and counts[x] > 0):
        left, step = min(counts[length], room // length), 1
        while left > 0:  # binary splitting of the multiplicity
            take = min(step, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
    top, best = reach.bit_length() - 1, None
    for total in range(top, max(-1, top - slack - 1), -1):
        if reach >> total & 1:
            at, out = total, []
            for length, take, before in reversed(layers):
                if at >= length * take and before >> (at - length * take) & 1:
                    out += [length] * take
                    at -= length * take
            if best is None or len(out) < len(best):
                best = out
    return best


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) that take every piece of the histogram. Bins that are as full as can be
    use up the small lengths that later bins need, so each of SLACKS is tried, and the fewest bins are kept."""
    tries = (with_slack(counts, capacity, s) for s in SLACKS)
    return min(tries, key=lambda patterns: sum(n for _, n in patterns))


def with_slack(counts: dict[int, int], capacity: int, slack: int) -> list[tuple[list[int], int]]:
    counts, out = {k: v for k, v in counts.items() if v > 0}, []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        bin_ = [seed, *fullest(capacity - seed, counts, slack)]
        counts[seed] += 1
        need = {x: bin_.count(x) for x in set(bin_)}
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((bin_, times))
    return out


def slot_table(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Of each length, rows (first rank, first sequence, pieces per bin, offset of the first)."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for x in dict.fromkeys(lengths):
            n = lengths.count(x)
            slots.setdefault(x, []).append((ranks.get(x, 0), sequence, n, offset))
            ranks[x] = ranks.get(x, 0) + n * times
            offset += n * x
        sequence += times
    return {x: np.array(v, "i8") for x, v in slots.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity. pieces is read
    several times, so it should be a stored table."""
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `capacity` rows
    slots = slot_table(minimum_bin_slack(histogram, capacity))
    total, most = sum(histogram.values()), max(histogram.values(), default=0)
    salts = max(1, round(most / max(1000, total / 2000)))
    columns = pieces.columns
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in ("doc_id", "piece") if c in columns], length), F.lit(salts)).cast("int"))
    key = Window.partitionBy(length, "__salt").orderBy(*[c for c in ("doc_id", "piece") if c in columns])
    sizes = salted.groupBy(length, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(length).orderBy("__salt")) - F.col("__n")
    firsts = sizes.select(length, "__salt", before.alias("__first"))
    ranked = (
        salted.withColumn("__row", F.row_number().over(key) - 1)
        .join(firsts, [length, "__salt"])
        .withColumn("__rank", F.col("__first") + F.col("__row"))
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), "i8"), np.zeros(len(pdf), "i8")
            lengths, ranks = pdf[length].to_numpy("i8"), pdf["__rank"].to_numpy("i8")
            for x in np.unique(lengths):
                own, rows = lengths == x, slots[int(x)]
                at = rows[np.searchsorted(rows[:, 0], ranks[own], "right") - 1]
                bins, nth = np.divmod(ranks[own] - at[:, 0], at[:, 2])
                sequence[own], offset[own] = at[:, 1] + bins, at[:, 3] + nth * x
            yield pdf[columns].assign(sequence_id=sequence, offset=offset)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*columns, "__rank").mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(tokenize(docs, capacity), "pieces"), capacity)
