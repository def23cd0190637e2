"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case, each run of white space one space, trimmed). A test
item of n characters may occur with k = floor(n * error_share) edits. It is split into
k + 1 pieces of nearly equal length: k edits leave at least one of them intact, so
every such occurrence holds an exact piece. Documents are scanned in one pass for all
pieces (Aho-Corasick); each hit names a diagonal, and the window around it is verified
with Myers' bit-parallel distance (whole item against any part of the window).

The benchmark is the query set: it is dealt in blocks of at most `block_chars`
characters, each sent to the executors and run against all documents, so that what is
sent stays bounded however large the benchmark grows.

Items shorter than `min_chars` after normalising occur only without edits and on word limits
(no letter or digit beside them), as a few edits would turn them into other words.

Defined results: null or empty documents and items match nothing; repeated rows are each
matched; documents and items without an id are matched like all others, their ids null (of
items without an id, a document gets the nearest); an empty table on either side gives an empty
result, or leaves all documents; other columns are ignored by `leaks` and kept by
`decontaminate`, which needs no ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

ERROR_SHARE = 0.08
MIN_CHARS = 40
BLOCK_CHARS = 4_000_000
SCHEMA = "doc_id long, item_id long, distance long, first_char long, last_char long"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(start, piece) of errors + 1 pieces whose lengths differ by one at most."""
    n = errors + 1
    edges = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def myers(item: str, window: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the part of window nearest to item: the least distance, then the
    first end; None if it is over `most`. One bit per character of the item (Myers 1999)."""
    m = len(item)
    at: dict[str, int] = {}
    for k, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << k
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = every, 0, m, None
    for end, c in enumerate(window, 1):
        eq = at.get(c, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        h_minus, h_plus = plus & d0, minus | (every & ~(plus | d0))
        score += bool(h_plus & top) - bool(h_minus & top)
        shifted = (h_plus << 1) & every
        minus = shifted & d0
        plus = ((h_minus << 1) & every) | (every & ~(shifted | d0))
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
    return best


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str]], error_share: float = ERROR_SHARE, min_chars: int = MIN_CHARS):
        self.items = [(i, t, int(len(t) * error_share) if len(t) >= min_chars else 0) for i, t in items if t]
        self.least = min_chars
        spots: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, errors) in enumerate(self.items):
            for start, piece in pieces(t, errors):
                spots.setdefault(piece, []).append((k, start + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in spots.items():
            self.automaton.add_word(piece, where)
        if spots:
            self.automaton.make_automaton()
        self.some = bool(spots)

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, first, last character) of the best match of each item."""
        out: list[tuple[int | None, int, int, int]] = []
        if not self.some:
            return out
        hits: dict[int, set[int]] = {}
        for last, where in self.automaton.iter(text):
            for k, end in where:
                hits.setdefault(k, set()).add(last + 1 - end)  # where the item would begin
        for k, starts in hits.items():
            item, t, errors = self.items[k]
            if len(t) < self.least:
                whole = [s for s in sorted(starts) if not text[s - 1 : s].isalnum() and not text[s + len(t) : s + len(t) + 1].isalnum()]
                if whole:
                    out.append((item, 0, whole[0], whole[0] + len(t)))
                continue
            best, upto = None, -1
            for s in sorted(starts):
                if s <= upto:
                    continue
                if text.startswith(t, s) if s >= 0 else False:
                    got, low = (0, len(t)), s
                else:
                    # one window for hits whose diagonals lie within 2 * errors
                    upto, low = s + 2 * errors, max(0, s - errors)
                    got = myers(t, text[low : upto + errors + len(t)], errors)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], low + got[1])
                    if not got[0]:
                        break
            if best:
                size = len(t) + best[0]
                back = myers(t[::-1], text[max(0, best[1] - size) : best[1]][::-1], best[0]) if best[0] else (0, len(t))
                out.append((item, best[0], best[1] - back[1], best[1]))
        return out


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark, each distinct item once, in blocks of at most block_chars characters (or one item)."""
    block: list[tuple[int | None, str]] = []
    size = 0
    for r in benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        t = normalise(r["text"])
        if block and size + len(t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["item_id"], t))
        size += len(t)
    yield block


def leaks(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that occurs in it: its best match."""
    docs = docs.select("doc_id", "text")

    def scan(own: list[tuple[int | None, str]]) -> DataFrame:
        made: list[Matcher] = []

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if not made:
                made.append(Matcher(own, error_share, min_chars))
            for pdf in batches:
                rows = []
                for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    best: dict[int | None, tuple] = {}
                    for item, *m in made[0].find(normalise(text)):
                        best[item] = min(best.get(item, (1 << 30,)), tuple(m))
                    rows += [(None if pd.isna(doc) else doc, item, *m) for item, m in best.items()]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "first_char", "last_char"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        return docs.mapInPandas(run, SCHEMA)

    out = None
    for own in blocks(benchmark, block_chars):
        out = scan(own) if out is None else out.unionByName(scan(own))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without those in which a benchmark item occurs; columns as they were. Rows are judged
    where they stand, so nothing is joined and rows without an id are judged as well."""

    def clean(own: list[tuple[int | None, str]]) -> Column:
        made: list[Matcher] = []

        @F.pandas_udf(T.BooleanType())
        def judge(texts: pd.Series) -> pd.Series:
            if not made:
                made.append(Matcher(own, error_share, min_chars))
            return pd.Series([not made[0].find(normalise(t)) for t in texts], dtype=bool)

        return judge("text")

    for own in blocks(benchmark, block_chars):
        docs = docs.where(clean(own))
    return docs
