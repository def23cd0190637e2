"""Ranked lexical search by Block-Max WAND.

Index. Each task turns its documents into shards of at most SHARD_TERMS terms, without a
shuffle. A shard holds, for each of its terms, the postings (place of the document in the
shard, occurrences) as gap-coded varints in blocks of POSTINGS postings; beside the
bytes stand each block's last document, its first byte and its maximum impact, so a block
can be judged and passed over unread. Impacts need the number of documents and of terms,
which one scan counts first; they are integers, as the score is.

Search. Queries go in blocks of QUERY_BYTES, each sent to every shard. A query opens its
lists of one block (a cursor has to read that one to stand anywhere) and moves over the
others shallowly: the bound of a document is what its open blocks give exactly plus the
maxima of the closed blocks that cover it. The pivots are the documents whose bound reaches
the threshold, the k-th best score so far (of this shard or of those the task saw before).
Blocks under the best pivots are decompressed, bounds and threshold follow, until no pivot
has a closed block. All pivots of a shard move at once, as arrays, where the textbook moves
one at a time. Blocks that no pivot meets are never decompressed. A document whose bound
equals the threshold still is a pivot, so ties are exact.

Defined results: a document without a term (null, empty) counts for nothing and is never found;
every row of documents is one document and every row of items one item, so repeated rows
appear as often as they occur; equal scores go by doc_id, null first; items without a term
that scores have no rows; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from caseloom.session import materialize

POSTINGS, SHARD_TERMS, QUERY_BYTES = 128, 4_000_000, 1_000_000
#: Terms are runs of ASCII letters, digits and bytes above 127: all else becomes a space, A-Z lower case.
TABLE = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
INDEX = "shard string, term binary, df long, block_last array<int>, block_max array<long>, block_at array<int>, data binary, doc_ids array<long>"
HITS = "query int, doc_id long, score long"
FIRST = -(1 << 63)  # stands for a null doc_id in comparisons


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Places(dict):
    """Numbers keys in the order of their first appearance."""

    def __missing__(self, key: bytes) -> int:
        self[key] = at = len(self)
        return at


@dataclass(frozen=True)
class Index:
    table: DataFrame
    n_docs: int
    n_terms: int


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian base-128 bytes of values, and where each begins (one more at the end)."""
    size = 1 + sum((values >= 1 << 7 * k).astype("i8") for k in range(1, 5))
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(at[-1], "u1")
    for k in range(5):
        has = size > k
        out[at[:-1][has] + k] = (values[has] >> 7 * k) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, at


def read_varints(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    shift = 7 * (np.arange(len(data)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((data & 127).astype("i8") << shift, starts)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 75 + 25 * n * n_docs // max(n_terms, 1)


def shard_batches(name: str, docs: list[tuple[int | None, np.ndarray]], places: Places, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The header row of a shard (doc_ids) and its term rows, in order of terms."""
    schema = pa.schema([("shard", pa.string()), ("term", pa.binary()), ("df", pa.int64()), ("block_last", pa.list_(pa.int32())), ("block_max", pa.list_(pa.int64())), ("block_at", pa.list_(pa.int32())), ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
    n = np.array([len(t) for _, t in docs], "i8")
    m = lengths(n, n_docs, n_terms)
    none = [pa.nulls(1, f.type) for f in schema]
    m_bytes = pa.array([m.astype("<i8").tobytes()], pa.binary())
    yield pa.record_batch([pa.array([name]), *none[1:6], m_bytes, pa.array([[d for d, _ in docs]], pa.list_(pa.int64()))], schema=schema)
    words = sorted(places)
    rank = np.empty(len(words), "i8")
    rank[[places[w] for w in words]] = np.arange(len(words))
    keys = rank[np.concatenate([t for _, t in docs])] * len(docs) + np.repeat(np.arange(len(docs)), n)
    keys, tf = np.unique(keys, return_counts=True)
    term, doc = np.divmod(keys, len(docs))
    df = np.bincount(term, minlength=len(words))
    first = np.concatenate(([0], np.cumsum(df)))
    in_term = np.arange(len(keys)) - np.repeat(first[:-1], df)
    block = np.flatnonzero(in_term % POSTINGS == 0)
    gap = np.diff(doc, prepend=0)
    gap[block] = doc[block]
    data, at = varints(np.column_stack((gap, tf)).ravel())
    ends = np.append(block[1:], len(keys))
    per_term = np.concatenate(([0], np.cumsum(-(-df // POSTINGS)))).astype("i4")
    lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(per_term), pa.array(v.astype(kind)))
    term_at = at[2 * first].astype("i4")
    yield pa.record_batch(
        [
            pa.repeat(name, len(words)),
            pa.array(words, pa.binary()),
            pa.array(df),
            lists(doc[ends - 1], "i4"),
            lists(np.maximum.reduceat(impact(tf, m[doc]), block), "i8"),
            lists(at[2 * block] - term_at[term[block]], "i4"),
            pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(term_at), pa.py_buffer(data)]),
            pa.nulls(len(words), pa.list_(pa.int64())),
        ],
        schema=schema,
    )


def build_index(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> Index:
    """Index of all documents (doc_id, text), stored in the shared folder."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(terms(t.as_py() or b"")) for t in batch.column("text")]
            yield pa.record_batch([pa.array([sum(map(bool, n))]), pa.array([sum(n)])], ["docs", "terms"])

    counted = source.select("text").mapInArrow(count, "docs long, terms long")
    n_docs, n_terms = counted.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, held, gathered, places = TaskContext.get().partitionId(), 0, 0, [], Places()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms(text.as_py() or b"")
                if words:
                    gathered.append((doc_id, np.fromiter(map(places.__getitem__, words), "i4", len(words))))
                    held += len(words)
                if held >= shard_terms:
                    yield from shard_batches(f"{task}-{k}", gathered, places, n_docs, n_terms)
                    k, held, gathered, places = k + 1, 0, [], Places()
        if gathered:
            yield from shard_batches(f"{task}-{k}", gathered, places, n_docs, n_terms)

    return Index(materialize(source.mapInArrow(run, INDEX), "lexical-index"), n_docs, n_terms)


class PostingList:
    """One term's postings in a shard; blocks are decompressed when first asked for."""

    def __init__(self, df: int, block_last: list[int], block_max: list[int], block_at: list[int], data: bytes, m: np.ndarray):
        self.df, self.m = df, m
        self.last, self.most = np.array(block_last), np.array(block_max)
        self.at, self.data = np.append(block_at, len(data)), np.frombuffer(data, "u1")
        self.is_open = np.zeros(len(self.last), bool)
        self.docs, self.impacts = np.empty(df, "i8"), np.empty(df, "i8")
        self.spans = np.diff(self.last, prepend=-1)  # documents that each block covers

    def open(self, blocks: np.ndarray) -> np.ndarray:
        """Places of the blocks' postings in docs and impacts."""
        new = blocks[~self.is_open[blocks]]
        places = lambda b: (p := (b[:, None] * POSTINGS + np.arange(POSTINGS)).ravel())[p < self.df]
        if len(new):
            gap, tf = read_varints(np.concatenate([self.data[self.at[b] : self.at[b + 1]] for b in new])).reshape(-1, 2).T
            size = np.minimum(self.df - new * POSTINGS, POSTINGS)
            start = np.cumsum(size) - size
            run = np.cumsum(gap)
            doc = run - np.repeat(run[start] - gap[start], size)
            at = places(new)
            self.docs[at], self.impacts[at] = doc, impact(tf, self.m[doc])
            self.is_open[new] = True
        return places(blocks)


class Best:
    """The k best (score, doc_id) so far."""

    def __init__(self, k: int):
        self.k, self.hits = k, []

    @property
    def least(self) -> int:
        return self.hits[-1][0] if len(self.hits) == self.k else 1

    def add(self, hits: list[tuple[int, int]]) -> None:
        self.hits = sorted(self.hits + hits, key=lambda h: (-h[0], h[1]))[: self.k]


def search_shard(query: list[tuple[bytes, int]], lists: dict[bytes, PostingList], doc_ids: np.ndarray, best: Best) -> None:
    """Adds the shard's best documents; query: (term, weight times occurrences)."""
    own = [(w, lists[t]) for t, w in query if t in lists]
    if sum(w * int(x.most.max()) for w, x in own) < best.least:
        return
    exact = np.zeros(len(doc_ids), "i8")
    closed = np.zeros(len(doc_ids), "i8")  # sum of the maxima of closed blocks over each document
    waiting = []
    for w, x in own:
        if len(x.last) == 1:
            at = x.open(np.array([0]))
            exact[x.docs[at]] += w * x.impacts[at]
        else:
            closed[: x.last[-1] + 1] += np.repeat(w * x.most, x.spans)
            waiting.append((w, x, np.ones(len(x.last), bool)))
    pivots = 2 * best.k
    while True:
        least = best.least
        if len(exact) > best.k:
            least = max(least, int(np.partition(exact, -best.k)[-best.k]))
        bound = exact + closed
        live = np.flatnonzero((bound >= least) & (closed > 0))
        if not len(live):
            break
        if len(live) > pivots:
            live = np.sort(live[np.argpartition(bound[live], -pivots)[-pivots:]])
        pivots *= 4
        for w, x, shut in waiting:
            meets = np.unique(np.searchsorted(x.last, live))
            meets = meets[meets < len(shut)]
            meets = meets[shut[meets]]
            if len(meets):
                shut[meets] = False
                at = x.open(meets)
                exact[x.docs[at]] += w * x.impacts[at]
                for b in meets:
                    closed[x.last[b] + 1 - x.spans[b] : x.last[b] + 1] -= w * x.most[b]
    found = np.flatnonzero(exact >= max(least, 1))
    best.add(list(zip(exact[found].tolist(), doc_ids[found].tolist(), strict=True)))


def search_block(index: Index, queries: list[Counter], k: int) -> DataFrame:
    """(query, doc_id, score): the k best of each task's shards."""
    spark = index.table.sparkSession
    words = sorted({t for q in queries for t in q})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in words], "term binary").withColumn("__wanted", F.lit(True)))  # at most QUERY_BYTES
    df = dict(index.table.join(wanted, "term").groupBy("term").agg(F.sum("df")).collect())
    weight = {bytes(t): math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = [[(t, c * weight[t]) for t, c in q.items() if weight.get(t)] for q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        shard, doc_ids, m, lists = None, None, None, {}

        def finish() -> None:
            for q, b in zip(asked, best, strict=True):
                if shard is not None and q:
                    search_shard(q, lists, doc_ids, b)

        for batch in batches:
            for row in batch.to_pylist():
                if row["term"] is None:
                    finish()
                    shard, lists = row["shard"], {}
                    doc_ids = np.array([FIRST if d is None else d for d in row["doc_ids"]], "i8")
                    m = np.frombuffer(row["data"], "<i8")
                else:
                    lists[row["term"]] = PostingList(row["df"], row["block_last"], row["block_max"], row["block_at"], row["data"], m)
        finish()
        hits = [(q, None if d == FIRST else d, s) for q, b in enumerate(best) for s, d in b.hits]
        yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])

    rows = index.table.join(wanted, "term", "left").where("term is null or __wanted").drop("__wanted").select(*index.table.columns)
    return rows.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term")).mapInArrow(run, HITS)


def search(index: Index, items: DataFrame, k: int = 20, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item (item_id, text)."""
    spark, kind = items.sparkSession, items.schema["item_id"].dataType.simpleString()
    parts: list[DataFrame] = []

    def answer(block: list[tuple]) -> None:
        names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], f"query int, item_id {kind}")
        hits = search_block(index, [q for _, q in block], k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(materialize(top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "lexical-hits"))  # names: at most QUERY_BYTES

    block, held = [], 0
    for item, text in items.select("item_id", F.col("text").cast("binary")).toLocalIterator():
        q = Counter(terms(bytes(text or b"")))
        if q:
            block.append((item, q))
            held += sum(map(len, q))
        if held >= query_bytes:
            answer(block)
            block, held = [], 0
    if block or not parts:
        answer(block)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
