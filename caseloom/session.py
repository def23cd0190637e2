"""Session and shared-folder helpers."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "caseloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; `master` is for local runs only."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the
    cluster names one. Only in local runs one is made where that is unset; on a cluster, a
    folder of the driver's machine would lose what executors write."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        root = os.path.join(tempfile.gettempdir(), "checkpoints", "caseloom")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Partitions of `dealt` for each of the scan's.
SHARES = 8


def dealt(rows: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """rows, made of the scan `source`, by keys, in SHARES partitions for each of the scan's. A number that is given isn't coalesced:
    adaptive execution goes by compressed bytes, and hits and postings take a hundred times that in a task's memory."""
    return rows.repartition(SHARES * max(1, source.rdd.getNumPartitions()), *keys)


#: Shuffle files go as soon as the execution that wrote them ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage,
    and a lost executor costs a re-read, not a recomputation. by: a column whose values have folders of their own."""
    return materialize_parts([df], label, by)


def materialize_parts(parts: Iterable[DataFrame], label: str, by: str | None = None) -> DataFrame:
    """One table of all parts, of one schema, each written before the next is asked for: only one needs room for its shuffles."""
    for k, df in enumerate(parts):
        if not k:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path, partitionBy=by)
        finally:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def tidy(run: Callable[[Iterator], Iterator], *forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """run, a function of a task's batches; as a task ends, each forget (a function of a module, as a
    task gets copies of all else) is called, and what Arrow and the C library
    keep of freed memory goes back. Python workers outlive a task, and an executor has several: what idle ones hold
    comes on top of what the steps after this one need."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return whole


def discard(*stored: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more: all that was made of them
    is stored itself. Sessions without a JVM at hand leave them to the folder's owner."""
    for df in stored:
        jvm = getattr(df.sparkSession, "_jvm", None)
        if jvm is not None:
            path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
