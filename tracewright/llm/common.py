"""Shared-folder tables, split rules and byte-level helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Word separators of every contract: the six ASCII white-space bytes, which are also what bytes.split() cuts at.
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a local session (tests, one machine) gets a temporary folder until it ends; any other
    gets a RuntimeError, since executors wouldn't see such a folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tracewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tracewright/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that any executor can read."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    jvm, path = df.sparkSession._jvm, df.shared_path
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # what ran last is held by events that listeners still have to see
        with contextlib.suppress(Py4JJavaError):
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: A key is hot if it has a share of this or more of the rows; so at most its inverse of keys are hot.
HOT_SHARE = 1e-4
#: Of fewer rows in all, no key's rows are more than one task bears.
SMALL = 1_000_000


def join_hot(rows: DataFrame, side: DataFrame, on: list[str], count_col: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row per key and in count_col how many of the total rows have that key.

    Hot keys, at most 1/HOT_SHARE of them, are broadcast, so none is one task's; only the other rows are shuffled. With a
    total below SMALL it is a plain join of the same result.
    """
    if total < SMALL:
        return rows.join(side.drop(count_col), on, how)
    hot = F.col(count_col) >= max(2.0, HOT_SHARE * total)
    few = F.broadcast(side.where(hot).drop(count_col))
    rest = rows.join(F.broadcast(side.where(hot).select(*on)), on, "left_anti").join(side.where(~hot).drop(count_col), on, how)
    return rows.join(few, on).unionByName(rest)


#: Rows of an Arrow batch of texts that a function turns into Python values, and hands back, at once.
PART = 256


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of PART rows, so that neither the worker nor the JVM holds results of thousands of texts in one piece."""
    for batch in batches:
        for i in range(0, batch.num_rows, PART):
            yield batch.slice(i, PART)


def give_back() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def sparing(run: Callable) -> Callable:
    """run, a function for mapInArrow, whose worker gives freed memory back to the system when its task ends: workers live on between tasks."""

    def spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return spared


def spared_driver(fit: Callable) -> Callable:
    """fit, after which the driver gives freed memory back to the system: the sampled rows' many small arrays else stay with it for the rest of the session."""

    @functools.wraps(fit)
    def spared(*args, **options):
        try:
            return fit(*args, **options)
        finally:
            gc.collect()
            give_back()

    return spared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def words_of(data: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; null has none."""
    return data.lower().split() if data else []


def lower_bytes(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data.lower() if data else b"", dtype=np.uint8)


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on uint64 arrays: a counter becomes a well-mixed word."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_ngrams(b: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashed bucket of every n-gram of bytes in b (uint8); none if b is shorter than n."""
    m = len(b) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.int64)
    x = b[:m].astype(np.uint32)
    for j in range(1, n):
        x = x * np.uint32(257) + b[j : j + m]
    x = (x ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)
    return (x >> np.uint32(32 - bits)).astype(np.int64)


def hashed_sample(rows: DataFrame, id_col: str, strata: str, max_rows: int, columns: list[str], digest: Callable | None = None, digested: str = "", seed: int = 7) -> list:
    """At most max_rows rows for a fit, split evenly over the strata, lowest seeded hash of the id first.

    digest: an Arrow function of (hash, id, *columns) that replaces the last column by the digested ones before rows
    come to the driver.

    Two passes: counts per stratum (pre-aggregated), then a row-local hash threshold of about 1.3 times the quota,
    so what reaches the driver is bounded by max_rows and not by the input. Repeatable for equal input.
    """
    counts = {r[strata]: r["count"] for r in rows.groupBy(strata).count().orderBy(F.desc("count"), strata).limit(max_rows).collect()}
    if not counts:
        return []
    quota = max(1, max_rows // len(counts))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(strata) == F.lit(value), F.lit(min(1.0, 1.3 * quota / n + 8.0 / n))).otherwise(share)
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    u = (F.shiftrightunsigned(h, 11).cast("double")) / float(1 << 53)
    some = rows.where(u < share).select(h.alias("__h"), id_col, *[c for c in columns if c != id_col])
    if digest is not None:
        some = some.mapInArrow(digest, StructType([*some.schema.fields[:-1], *StructType.fromDDL(digested).fields]))
    got = some.collect()
    got.sort(key=lambda r: (str(r[strata]), r["__h"], str(tuple(r))))
    out, seen = [], {}
    for r in got:
        seen[r[strata]] = seen.get(r[strata], 0) + 1
        if seen[r[strata]] <= quota:
            out.append(r)
    return out
