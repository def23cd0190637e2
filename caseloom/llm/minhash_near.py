"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its distinct shingles of `words` words, 2 unless told otherwise (words are maximal runs of
characters other than space and \\t..\\r, A-Z lower-cased; with fewer words than that, the
whole sequence is one shingle; without words, the set is empty and links with nothing).
Its signature is CHUNKS * WIDTH minhashes of `BITS` bits. Signatures are split into
CHUNKS chunks. Two signatures that differ in at most T = CHUNKS * (ERRORS + 1) - 1 places
have, by pigeonhole, a chunk with at most ERRORS differing places; every chunk therefore
emits one key for each way to leave ERRORS places out, and such pairs always share
a key. With 13 chunks of 6 and one error, T is 25 of 78; a pair of similarity 0.8 differs
in 15.6 places on average and is missed with a probability of about 1e-6.

Documents with equal sets (by a 128-bit fingerprint) are one row of the join.
Candidates are verified on their full sets: 100 * intersection >= 80 * union.

Defined results: null and empty texts are kept, each alone; repeated rows with one
doc_id are one document (the least fingerprint of its texts stands for it); an empty
table gives an empty result; other columns are ignored by `near_duplicates` and kept by
`keep_one`. Rows without doc_id are kept and never linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.linking import Rule, candidates, half, linked_groups, sized
from caseloom.session import discard, materialize, tidy

CHUNKS, WIDTH, ERRORS, BITS = 13, 6, 1, 16
WORDS, PERCENT = 2, 80
MEMORY = 500_000

_rng = np.random.default_rng(20_240_601)
_ODD = _rng.integers(1 << 62, 1 << 63, CHUNKS * WIDTH, dtype="u8") | np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, CHUNKS * WIDTH, dtype="u8")
_memory: dict[bytes, int] = {}


def forget() -> None:
    _memory.clear()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, "u8")
    try:
        h = np.fromiter(map(_memory.__getitem__, ws), "u8", len(ws))
    except KeyError:
        if len(_memory) > MEMORY:
            _memory.clear()
        for w in ws:
            if w not in _memory:
                _memory[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(_memory.__getitem__, ws), "u8", len(ws))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(words, len(h)), "u8")
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    f = xxhash.xxh3_128_intdigest(s.tobytes())
    return (f >> 64) - (1 << 63), (f & (1 << 64) - 1) - (1 << 63)


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(len(_ODD), np.iinfo("u8").max, "u8")
    for at in range(0, len(s), 4096):
        least = np.minimum(least, ((s[at : at + 4096, None] ^ _XOR) * _ODD).min(axis=0))
    least ^= least >> np.uint64(31)
    least *= np.uint64(0xD6E8FEB86659FD93)
    return (least >> np.uint64(64 - BITS)).astype("i4")


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig) of documents (doc_id, text); sig is null for empty sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part, rows = pdf.iloc[at : at + 500], []
                for doc, text in zip(part["doc_id"], part["text"], strict=True):
                    s = shingles(text, words)
                    sig = signature(s)
                    rows.append((doc, len(s), *fingerprint(s), sig if len(s) else None))
                yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(tidy(run, forget), "doc_id long, n_shingles long, f1 long, f2 long, sig array<int>")


def chunk_keys(sig: Column) -> Column:
    """One key for each chunk and each choice of ERRORS of its places to leave out."""
    keys = []
    for c in range(CHUNKS):
        for out in combinations(range(WIDTH), ERRORS):
            rest = [F.get(sig, c * WIDTH + k) for k in range(WIDTH) if k not in out]
            keys.append(F.xxhash64(F.lit(c), F.lit(sum(1 << k for k in out)), *rest))
    return F.array(*keys)


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, s): the full sets of the documents named in ids (id, f1, f2), f1 and f2 being
    the set's fingerprint, which tells rows with one doc_id apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                rows = []
                for doc, text, f1, f2 in pdf.iloc[at : at + 200].itertuples(index=False):
                    s = shingles(text, words)
                    if fingerprint(s) == (f1, f2):
                        rows.append((doc, s.view("i8")))
                yield pd.DataFrame(rows, columns=["id", "s"])

    wanted = docs.select("doc_id", "text").join(sized(ids).withColumnRenamed("id", "doc_id"), "doc_id")
    return wanted.select("doc_id", "text", "f1", "f2").mapInPandas(tidy(run, forget), "id long, s array<long>")


#: A link: MORE * (size of the difference of both sets) <= LESS * (sum of their sizes).
LESS, MORE = 100 - PERCENT, 100 + PERCENT


def least_shared(d: Column, n: Column, nr: Column, apart: Column) -> Column:
    """Fewest differences that a row shares with one it is linked to. What the two don't share
    is at most LESS / MORE * (sum of their sizes), and the other has at most 100 / PERCENT * n
    members. If the other is apart, it has over LESS / MORE * (its size + nr) differences of its
    own, so more than half of this row's are shared, up to the sizes of this row and the reference."""
    of_sizes = d - F.floor(F.lit(LESS) * (n + F.floor(100 * n / PERCENT)) / MORE)
    of_apart = F.floor((MORE * d + LESS * (nr - n)) / (2 * MORE)) + 1
    return F.greatest(F.lit(1), of_sizes, F.when(apart, F.lit(1)).otherwise(of_apart))


def may_link(x: Callable[[str], Column], y: Callable[[str], Column], shared: Column) -> Column:
    sizes = 100 * F.least(x("n"), y("n")) >= PERCENT * F.greatest(x("n"), y("n"))
    return sizes & (2 * MORE * shared >= MORE * (x("d") + y("d")) - LESS * (x("n") + y("n")))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept)."""
    found = profiles(docs, words)
    first = F.min(F.struct("f1", "f2", "n_shingles", "sig"))
    profile = materialize(found.groupBy("doc_id").agg(first.alias("p")).select("doc_id", "p.*"), "minhash-profiles")
    some = profile.where("n_shingles > 0")
    copies = materialize(
        some.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("__last"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "minhash-sets"
    )
    entries = copies.select("id", F.explode(chunk_keys(F.col("sig"))).alias("key"))
    size = copies.select("id", "n", "f1", "f2")

    def with_sets(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """pairs (a, b) with both sets, sa and sb, and the stored table of sets."""
        named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        ids = materialize(size.join(named, "id").select("id", "f1", "f2"), "minhash-ids")
        sets = materialize(shingle_sets(docs, ids, words), "minhash-members")
        discard(ids)
        both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        return both.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a"), sets

    def verify(pairs: DataFrame) -> DataFrame:
        a = size.select(F.col("id").alias("a"), F.col("n").alias("na"))
        b = size.select(F.col("id").alias("b"), F.col("n").alias("nb"))
        fit = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").select("a", "b", "na", "nb")
        fit = materialize(fit, "minhash-pairs")
        both, sets = with_sets(fit)
        both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
        union = F.col("na") + F.col("nb") - F.col("common")
        links = materialize(both.where(100 * F.col("common") >= PERCENT * union).select("a", "b", (F.col("common") / union).alias("score")), "minhash-links")
        discard(fit, sets)
        return links

    def differences(pairs: DataFrame) -> DataFrame:
        both, sets = with_sets(pairs.select(F.col("ref").alias("a"), F.col("id").alias("b")))
        diff = half(F.concat(F.array_except("sb", "sa"), F.array_except("sa", "sb")))  # equal ones stay apart: the size is exact
        both = both.select(F.col("a").alias("ref"), F.col("b").alias("id"), F.size("sb").alias("n"), F.size("sa").alias("nr"), diff.alias("diff"))
        sums, d = F.col("n") + F.col("nr"), F.size("diff")
        out = materialize(both.withColumn("score", F.when(MORE * d <= LESS * sums, (sums - d) / (sums + d))), "minhash-differences")
        discard(sets)
        return out

    banded = candidates(entries, size.select("id", "n"), "minhash")
    groups, links = linked_groups(banded, verify, differences, Rule(least_shared, may_link), "minhash")
    of_set = copies.where("id < __last").select("f1", "f2", "id").join(groups, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("c"))
    alone = copies.where("id = __last").join(groups, "id").select("f1", "f2", F.col("component").alias("c"))
    linked = materialize(of_set.unionByName(alone), "minhash-components")
    discard(copies, groups, links)
    return (
        profile.select("doc_id", "n_shingles", "f1", "f2")
        .join(linked, ["f1", "f2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c")).alias("c"))
        .select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs without those that are near copies of a kept one; columns as they were."""
    gone = near_duplicates(docs, words).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
