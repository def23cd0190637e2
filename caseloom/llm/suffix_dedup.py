"""Suffix-array dedup: byte strings of LENGTH bytes that occur more than once.

A difference-cover construction, truncated at depth LENGTH, as longer prefixes don't
matter here:

1. Sampled suffixes start at offsets whose residue modulo PERIOD lies in COVER, a perfect
   difference set: any two suffixes can be moved by one and the same 0..PERIOD-1 bytes
   so that both are sampled. Each gets a name for its first NAME = LENGTH - PERIOD + 1 bytes.
   The names are sorted and neighbours compared; suffixes of unique name are discarded,
   for no string of LENGTH bytes that reaches them can repeat.
2. Names are then taken in triples: the name of LENGTH bytes at i is that of
   (name(i), name(i + 66), name(i + 132)), which overlap by two bytes.
3. The remaining suffixes, sampled or not, are those within PERIOD bytes before a
   surviving sample. They are merged by sorting their triple names; neighbours with equal
   prefixes of LENGTH bytes repeat, and the bytes under them are removed.

Names are 64-bit fingerprints of the bytes (polynomial over random byte values, mixed),
not ranks: only equality of prefixes matters, and fingerprints need no global order. Two
different strings of LENGTH bytes get one name with a probability of about 2**-64.

Texts that equal another whole text are set aside first, so each is handled once.
Sorting is done by hash range (`bucket`), whose number follows the size of the corpus. A
task sends each distinct name once, with a mark if it has seen it twice, so no name,
however frequent, gathers more rows than there are batches.

Defined results: null text counts as empty; texts under LENGTH bytes lose nothing;
repeated rows (same doc_id and text) are copies of one another; doc_id must tell
different texts apart, and rows without one lose nothing and match nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.linking import sized
from caseloom.session import materialize

LENGTH, PERIOD = 200, 133
NAME = LENGTH - PERIOD + 1
STEP = (LENGTH - NAME) // 2
# A perfect difference set modulo 133 (checked in the tests).
COVER = (0, 1, 8, 21, 39, 43, 48, 54, 73, 105, 117, 131)
BATCH_BYTES, BUCKET_BYTES = 2_000_000, 8_000_000
MOST_ROWS, MOST_BYTES = 400_000, 24_000_000  # of spans, up to which they are broadcast

_rng = np.random.default_rng(7_919)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype="u8")
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BATCH_BYTES + 200_000)
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, b, "u8")
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Names:
    """Names of the suffixes of one buffer."""

    def __init__(self, data: bytes):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, "u8")
        np.cumsum(_VALUE[np.frombuffer(data, "u1")] * up[: len(data)], out=self.sums[1:])

    def at(self, i: np.ndarray) -> np.ndarray:
        return mix((self.sums[i + NAME] - self.sums[i]) * self.down[i])

    def triples(self, i: np.ndarray) -> np.ndarray:
        a, b, c = self.at(i), self.at(i + STEP), self.at(i + 2 * STEP)
        return mix((a * np.uint64(3) + mix(b)) * np.uint64(0xC2B2AE3D27D4EB4F) + c)


_cover = np.zeros(PERIOD, bool)
_cover[list(COVER)] = True


def sampled(sizes: np.ndarray) -> np.ndarray:
    """Places, in a buffer of texts of these sizes, of the sampled suffixes that have NAME bytes."""
    starts = np.cumsum(sizes) - sizes
    out = []
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if n >= LENGTH:
            out.append(s + np.flatnonzero(np.resize(_cover, n - NAME + 1)))
    return np.concatenate(out) if out else np.zeros(0, "i8")


def every(sizes: np.ndarray) -> np.ndarray:
    """Places of all suffixes that have LENGTH bytes."""
    starts = np.cumsum(sizes) - sizes
    out = [np.arange(s, s + n - LENGTH + 1) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True) if n >= LENGTH]
    return np.concatenate(out) if out else np.zeros(0, "i8")


def squeeze(*columns: np.ndarray) -> bytes:
    """Byte planes of integer columns, compressed."""
    raw = b"".join(np.ascontiguousarray(c.view("u1").reshape(len(c), -1).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(blob[:4], "little"), zstandard.ZstdDecompressor().decompress(blob[4:]) if len(blob) > 4 else b"", 0, []
    for k in kinds:
        width = np.dtype(k).itemsize
        planes = np.frombuffer(raw, "u1", n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(k).ravel())
        at += n * width
    return out


NAMED, KNOWN, TEXTS = 0, 1, 2


def send(data: bytes, keys: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, uid: int, buckets: int, triples: bool) -> list[tuple]:
    """Rows (bucket, uid, kind, blob) of one batch: its distinct names, by bucket; the places
    whose name occurs in it twice; and its texts' keys, offsets and sizes."""
    names, places = Names(data), every(sizes) if triples else sampled(sizes)
    if not len(places):
        return []
    f = names.triples(places) if triples else names.at(places)
    order = np.argsort(f, kind="stable")
    f, places = f[order], places[order].astype("u4")
    fresh = np.concatenate([[True], f[1:] != f[:-1]])
    several = ~fresh | np.concatenate([~fresh[1:], [False]])
    out = [(uid % buckets, uid, TEXTS, squeeze(keys, firsts, sizes.astype("i8")))]
    if several.any():
        out.append((uid % buckets, uid, KNOWN, squeeze(np.sort(places[several]))))
    f, places, several = f[fresh], places[fresh], several[fresh].astype("u1")
    bucket = ((f >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # rises with f
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(f)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        out.append((int(bucket[a]), uid, NAMED, squeeze(np.diff(f[a:b], prepend=np.uint64(0)), places[a:b], several[a:b])))
    return out


def repeated(source: DataFrame, buckets: int, triples: bool) -> DataFrame:
    """source: (key long, first long, body binary). (key, spans binary): of each row whose
    suffixes share a name with another, the union of what they reach (int64 pairs of begin and
    end, counted from `first`): LENGTH bytes on, and for samples PERIOD - 1 bytes back as well."""
    before = 0 if triples else PERIOD - 1

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uid, rows = TaskContext.get().partitionId() << 32, []

        def done() -> pd.DataFrame:
            out = send(b"".join(r[2] for r in rows), np.array([r[0] for r in rows], "i8"), np.array([r[1] for r in rows], "i8"), np.array([len(r[2]) for r in rows]), uid, buckets, triples)
            return pd.DataFrame(out, columns=["bucket", "uid", "kind", "blob"])

        size = 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows.append(r)
                size += len(r[2])
                if size >= BATCH_BYTES:
                    yield done()
                    uid, rows, size = uid + 1, [], 0
        if rows:
            yield done()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["kind"] == NAMED]
        passed = pdf[pdf["kind"] != NAMED][["uid", "kind", "blob"]]
        if not len(own):
            return passed
        cols = [unsqueeze(b, "u8", "u4", "u1") for b in own["blob"]]
        sizes = [len(c[0]) for c in cols]
        f = np.concatenate([np.cumsum(c[0], dtype="u8") for c in cols])
        order = np.argsort(f, kind="stable")
        same = f[order][1:] == f[order][:-1]
        shared = np.zeros(len(f), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        rows, at = [], 0
        for uid, c, n in zip(own["uid"], cols, sizes, strict=True):
            new = c[1][shared[at : at + n] & (c[2] == 0)]
            at += n
            if len(new):
                rows.append((uid, KNOWN, squeeze(np.sort(new))))
        return pd.concat([passed, pd.DataFrame(rows, columns=["uid", "kind", "blob"])])

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        known = pdf[pdf["kind"] == KNOWN]
        if len(known):
            places = np.sort(np.concatenate([unsqueeze(b, "u4")[0] for b in known["blob"]]).astype("i8"))
            keys, firsts, sizes = unsqueeze(pdf[pdf["kind"] == TEXTS]["blob"].iloc[0], "i8", "i8", "i8")
            ends = np.cumsum(sizes)
            upto = np.searchsorted(places, ends)
            for k, (a, b) in enumerate(zip(np.concatenate([[0], upto[:-1]]).tolist(), upto.tolist(), strict=True)):
                if b > a:
                    own = intervals(places[a:b] - (ends[k] - sizes[k]), before, LENGTH, int(sizes[k]))
                    rows.append((keys[k], (np.array(own, "i8") + firsts[k]).tobytes()))
        return pd.DataFrame(rows, columns=["key", "spans"])

    sent = source.select("key", "first", "body").mapInPandas(emit, "bucket int, uid long, kind int, blob binary")
    compared = sent.groupBy("bucket").applyInPandas(compare, "uid long, kind int, blob binary")
    return compared.groupBy("uid").applyInPandas(place, "key long, spans binary")


def intervals(starts: np.ndarray, before: int, after: int, size: int) -> list[tuple[int, int]]:
    """Union of [s - before, s + after), cut to [0, size)."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    a, b = np.maximum(starts - before, 0), np.minimum(starts + after, size)
    cut = np.flatnonzero(a[1:] > b[:-1])
    return list(zip(a[np.concatenate([[0], cut + 1])].tolist(), b[np.concatenate([cut, [len(a) - 1]])].tolist(), strict=True))


def union(spans: list[bytes]) -> list[tuple[int, int]]:
    """Union of spans, as `repeated` gives them, in order; spans that touch are one."""
    both = np.sort(np.concatenate([np.frombuffer(x, "i8").reshape(-1, 2) for x in spans]).view("i8,i8").ravel()).view("i8").reshape(-1, 2)
    out: list[tuple[int, int]] = []
    for a, b in both.tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def sized_spans(found: DataFrame) -> DataFrame:
    """(doc_id, spans) of found (key, spans), stored; with a hint to broadcast if that is
    small, by its bytes and its rows."""
    rows, size = found.agg(F.count(F.lit(1)), F.sum(F.length("spans"))).first()
    marks = found.groupBy(F.col("key").alias("doc_id")).agg(F.collect_list("spans").alias("spans"))
    return F.broadcast(marks) if rows <= MOST_ROWS and (size or 0) <= MOST_BYTES else marks


def regions(marked: DataFrame) -> DataFrame:
    """marked: (doc_id, text, spans). (key, first, body): the bytes within reach of surviving samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                rows = []
                for doc, text, spans in pdf.iloc[at : at + 200].itertuples(index=False):
                    data = text.encode()
                    for a, b in union(spans):
                        if b - a >= LENGTH:
                            rows.append((doc, a, data[a:b]))
                yield pd.DataFrame(rows, columns=["key", "first", "body"])

    return marked.select("doc_id", "text", "spans").mapInPandas(run, "key long, first long, body binary")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): what is left of each document without
    the bytes under a repeated string of LENGTH bytes. with_text adds those bytes as `kept`."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")
    whole = docs.select("doc_id", F.unhex(F.md5(F.encode("text", "utf-8"))).alias("h"), size.cast("long").alias("size"))
    groups = whole.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    groups = materialize(groups, "suffix-texts")
    total = groups.agg(F.sum("size")).first()[0] or 0
    buckets = int(max(16, total // BUCKET_BYTES))
    copied = groups.where(f"n > 1 and size >= {LENGTH}").select("h", "first")
    copies = materialize(whole.join(copied, "h").select("doc_id", (F.col("doc_id") != F.col("first")).alias("later")).distinct(), "suffix-copies")
    once = docs.join(sized(copies.where("later").select("doc_id")), "doc_id", "left_anti")
    once = once.where((size >= LENGTH) & F.col("doc_id").isNotNull())
    bodies = once.select(F.col("doc_id").alias("key"), F.lit(0).cast("long").alias("first"), F.encode("text", "utf-8").alias("body"))
    samples = materialize(repeated(bodies, buckets, False), "suffix-samples")
    near = materialize(regions(once.join(sized_spans(samples), "doc_id")), "suffix-regions")
    found = materialize(repeated(near, buckets, True), "suffix-repeats")
    joined = docs.join(sized_spans(found), "doc_id", "left").join(sized(copies), "doc_id", "left").select("doc_id", "text", "spans", F.col("later").isNotNull().alias("copied"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                rows = []
                for doc, text, found_spans, copied in pdf.iloc[at : at + 200].itertuples(index=False):
                    data, spans = text.encode(), []
                    if copied:
                        spans = [(0, len(data))]
                    elif found_spans is not None:
                        spans = union(found_spans)
                    edges = [0, *[x for s in spans for x in s], len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return joined.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
