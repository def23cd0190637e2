"""WARC archives: a deterministic sharded writer, and the reader.

Writer. Pages are sorted by page_id and cut into shards of about SHARD_BYTES of payload. The cuts
are exact: ids are range-sorted once without their pages, running totals are taken within each
range and carried over the ranges' totals, and a shard begins where a multiple of the
shard's size is passed. They depend on the rows alone, not on how the input is split or sampled,
so the same rows give the same files. Each shard is one task, which streams its pages in order,
writes every record as a gzip member with headers and digests made anew, and begins a new file when
FILE_BYTES of compressed bytes are reached.

Of pages with equal payloads of LEAST bytes or more, that of the largest page_id is stored and the
others become revisit records. Groups are found on digests alone; what a page refers to
travels as a short row beside the pages through the one shuffle by shard.

Commit. A task writes under a temporary name of its own attempt and reports (file, temporary name,
size, SHA-1, records) as a manifest row; Spark keeps only rows of tasks that ended well. Then each
reported file is renamed, which can be repeated, and the manifest is written under a temporary
name and renamed last. Readers go by the manifest alone: files of lost attempts are never read, and
without a manifest there is no archive.

Files are written through pyarrow's file systems (file, hdfs, s3, gs), so `root` may be in any
store that executors share.

Defined results: a null html is an empty payload; a null url has no target; rows that share page_id
and payload are one response and revisits of it (or all responses under LEAST bytes); a null page_id
sorts first and counts as the least; an empty table gives a manifest without files and an empty
result; other columns are ignored. Very long pages are held one at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from caseloom.session import materialize

LEAST, FILE_BYTES, SHARD_BYTES, MOST_SHARDS = 1000, 64_000_000, 32_000_000, 50_000
DATE = "2000-01-01T00:00:00Z"  # of every record: a clock would make files differ
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST_ROW = "file string, temporary string, bytes long, sha1 string, records long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_UNSAFE = re.compile(r"[\x00-\x20\x7f<>]")


def file_system(root: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(root)


def record_id(page_id: int | None, digest: bytes, copy: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest.hex()}:{copy}>"


def page_of(urn: str) -> int | None:
    page = urn.split(":")[2]
    return int(page) if page else None


def member(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, copy: int) -> bytes:
    """One record as a gzip member, the same bytes for the same page each time."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", DATE)]
    if url is not None:
        safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
        head.append(("WARC-Target-URI", safe))
        if safe != url or url != url.strip():
            head.append(("X-Source-URL", base64.b64encode(url.encode()).decode()))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, digest, 0))]
    head += [
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(lines.encode() + block + b"\r\n\r\n", 6, mtime=0)


def shard_starts(pages: DataFrame, shard_bytes: int) -> list[int]:
    """The first page_id of each shard but the first: at most MOST_SHARDS numbers."""
    sized = pages.where("page_id is not null").groupBy("page_id").agg(F.sum(F.octet_length("payload") + 500).alias("size"))
    ranged = materialize(sized.repartitionByRange("page_id").select("*", F.spark_partition_id().alias("range")), "warc-ids")
    totals = ranged.groupBy("range").agg(F.sum("size").alias("total"))
    whole = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    size = max(shard_bytes, -(-whole // MOST_SHARDS))
    # One row for each range, of which there are as many as shuffle partitions.
    before = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("before"))
    upto = F.sum("size").over(Window.partitionBy("range").orderBy("page_id"))
    placed = ranged.withColumn("upto", upto).join(F.broadcast(before), "range")
    shard = F.floor((F.col("before") + F.col("upto") - F.col("size")) / size)
    first = placed.groupBy(shard.alias("shard")).agg(F.min("page_id").alias("page_id"))
    return sorted(r.page_id for r in first.collect())[1:]


def write_archives(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least: int = LEAST) -> str:
    """Writes pages (page_id, url, html) as archives under root (an absolute path or URI) and
    returns root."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keyed = own.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    large = keyed.where(F.octet_length("payload") >= least).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    notes = large.join(groups, "digest").where("refers_to is not null and (page_id is null or page_id < refers_to)").distinct()
    no = F.lit(None)
    rows = notes.select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", no.cast("string").alias("url"), no.cast("binary").alias("payload")).unionByName(
        keyed.select("page_id", "digest", F.lit(1).alias("kind"), no.cast("long").alias("refers_to"), "url", "payload")
    )
    starts = shard_starts(own, shard_bytes)
    shards = len(starts) + 1
    temporary = f"{root.rstrip('/')}/_temporary"
    withdraw(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(temporary)
        fs.create_dir(folder, recursive=True)
        attempt, shard, n, out, sink, done = uuid.uuid4().hex, None, 0, None, None, []
        note, before, copy = None, None, 0

        def close() -> None:
            sink.close()
            done.append(out | {"sha1": out["sha1"].hexdigest()})

        for batch in batches:
            short = [batch.column(c).to_pylist() for c in ("shard", "page_id", "digest", "kind", "refers_to", "url")]
            for own, page_id, sha256, kind, refers_to, url, payload in zip(*short, batch.column("payload"), strict=True):
                key = (page_id, sha256)
                if kind == 0:
                    note = (key, refers_to)
                    continue
                data = payload.as_py()
                copy = copy + 1 if key == before else 0
                before = key
                noted = note is not None and note[0] == key
                again = noted or copy > 0 and len(data) >= least
                record = member(page_id, url, data, again, note[1] if noted else page_id if again else None, copy)
                if out is None or own != shard or out["bytes"] >= file_bytes:
                    if out is not None:
                        close()
                    shard, n = own, n if own == shard else 0
                    name = f"pages-{shard:05d}-{n:05d}.warc.gz"
                    out = {"file": name, "temporary": f"{name}.{attempt}", "bytes": 0, "sha1": hashlib.sha1(), "records": 0}
                    sink, n = fs.open_output_stream(f"{folder}/{out['temporary']}", compression=None), n + 1
                sink.write(record)
                out["sha1"].update(record)
                out["bytes"] += len(record)
                out["records"] += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("sha1", pa.string()), ("records", pa.int64())]))

    dealt = rows.withColumn("shard", shard_of(F.col("page_id"), starts)).repartitionById(shards, F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    manifest = materialize(ordered.mapInArrow(write, MANIFEST_ROW), "warc-manifest")
    commit(manifest, root)
    return root


def shard_of(page_id: Column, starts: list[int]) -> Column:
    """How many of the sorted starts are at or before page_id: a binary search over the bits of the answer."""
    if not starts:
        return F.lit(0)
    bounds = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")  # at most MOST_SHARDS numbers
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))])
    fits = lambda a, s: (a + s <= len(starts)) & (F.get(bounds, a + s - 1) <= page_id)
    return F.aggregate(steps, F.lit(0), lambda a, s: F.when(fits(a, s), a + s).otherwise(a))


def withdraw(root: str) -> None:
    """An archive that is written again is none until its new manifest stands."""
    fs, folder = file_system(root)
    for name in ("_manifest", "_manifest.tmp", "_temporary"):
        if fs.get_file_info(f"{folder}/{name}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{folder}/{name}")


def commit(manifest: DataFrame, root: str) -> None:
    """Renames the reported files to their names, then writes the manifest. Each step can be repeated."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(root)
        for batch in batches:
            for r in batch.to_pylist():
                old, new = f"{folder}/_temporary/{r['temporary']}", f"{folder}/{r['file']}"
                if fs.get_file_info(old).type == pa.fs.FileType.File:
                    fs.move(old, new)
                if fs.get_file_info(new).size != r["bytes"]:
                    raise OSError(f"{new} isn't the file of the manifest")
            yield batch

    moved = manifest.repartition("file").mapInArrow(rename, MANIFEST_ROW).select("file", "bytes", "sha1", "records")
    moved.repartition(1).sortWithinPartitions("file").write.mode("overwrite").parquet(f"{root.rstrip('/')}/_manifest.tmp")
    fs, folder = file_system(root)
    fs.move(f"{folder}/_manifest.tmp", f"{folder}/_manifest")
    if fs.get_file_info(f"{folder}/_temporary").type == pa.fs.FileType.Directory:
        fs.delete_dir(f"{folder}/_temporary")  # what lost attempts left


class Records:
    """WARC records of a stream of gzip members, one at a time."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.raw = source, b""

    def members(self) -> Iterator[bytes]:
        """The decompressed bytes of each member."""
        d, parts = zlib.decompressobj(31), []
        while True:
            data = self.raw or self.source.read(1 << 20)
            self.raw = b""
            if not data:
                if parts:
                    raise OSError("an archive ends within a record")
                return
            parts.append(d.decompress(data))
            if d.eof:
                self.raw = d.unused_data
                yield b"".join(parts)
                d, parts = zlib.decompressobj(31), []

    def __iter__(self) -> Iterator[dict]:
        for whole in self.members():
            head, _, rest = whole.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
            block = rest[: int(fields["content-length"])]
            if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
                raise OSError("not a WARC record")
            if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["warc-block-digest"].removeprefix("sha1:"):
                raise OSError(f"block digest of {fields['warc-record-id']} doesn't fit")
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
            digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
            revisit = fields["warc-type"] == "revisit"
            if not revisit and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
                raise OSError(f"payload of {fields['warc-record-id']} doesn't fit")
            source = fields.get("x-source-url")
            yield {
                "page_id": page_of(fields["warc-record-id"]),
                "url": base64.b64decode(source).decode() if source else fields.get("warc-target-uri"),
                "record_type": fields["warc-type"],
                "refers_to": page_of(fields["warc-refers-to"]) if revisit else None,
                "payload_bytes": size,
                "payload_digest": digest.hex(),
                "payload": None if revisit else payload,
            }


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """All records of the archives that root's manifest names; a revisit's payload is null."""
    manifest = spark.read.parquet(f"{root.rstrip('/')}/_manifest")
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(root)
        for batch in batches:
            for r in batch.to_pylist():
                out, held = [], 0
                with fs.open_input_stream(f"{folder}/{r['file']}", compression=None) as source:
                    n = 0
                    for record in Records(source):
                        out.append(record)
                        n, held = n + 1, held + len(record["payload"] or b"")
                        if held > 8_000_000 or len(out) >= 5_000:
                            yield pa.RecordBatch.from_pylist(out, schema=types)
                            out, held = [], 0
                if n != r["records"]:
                    raise OSError(f"{r['file']} has {n} records, not {r['records']}")
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=types)

    files = max(1, manifest.count())
    return manifest.repartition(min(files, 10_000), "file").mapInArrow(read, RECORD)
