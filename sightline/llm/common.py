"""Shared scratch space, file access from executors and vectorised text hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``; only a session without that
    setting (a local test) gets a temporary folder of this machine. Everything below
    is removed when the driver's Python ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="sightline-")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)  # a name without scheme is of the cluster's own file system
        full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        _ROOTS[app] = f"{full.rstrip('/')}/sightline-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _ROOTS[app])
    return f"{_ROOTS[app]}/{name}-{uuid.uuid4().hex[:8]}"


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized frame that nothing unwritten needs any more, and let Spark drop shuffles that nothing refers to."""
    _remove(df.sparkSession, df._scratch)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While it lasts, rows of whole texts go to Python few at a time: what a worker holds is bounded by these."""
    before = spark.conf.get(BATCH, "10000")
    if int(before) > rows or int(before) < 1:
        spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def keep_batches_small(spark: SparkSession, rows: int = 1000) -> None:
    """The same for a plan that is handed back unrun: the setting is read when it runs, so it must stay."""
    if int(spark.conf.get(BATCH, "10000")) > rows:
        spark.conf.set(BATCH, str(rows))


def give_back() -> None:
    """At the start of a Python task: what earlier tasks of the process freed goes back to the system, and large arrays do so as they are freed."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def open_fs(uri: str):
    """(filesystem, path) of a URI, usable in the executors' Python."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def running_sums(rows: DataFrame, keys: list[str], at: str, value: str, out: str, group: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``value`` in the rows before, by ``at`` (whole numbers from 0), within ``keys``.

    In two levels, so no task orders more than ``group`` rows or a row a group of them.
    """
    tall = rows.withColumn("_g", F.floor(F.col(at) / group))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = tall.groupBy(*keys, "_g").agg(F.sum(value).alias("_s"))
    base = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_g").alias("_h"), F.coalesce(F.sum("_s").over(before(keys, "_g")), F.lit(0).cast("long")).alias("_base"))
    same = F.col("_g") == F.col("_h")  # a row a group on that side
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    inner = tall.withColumn("_own", F.coalesce(F.sum(value).over(before([*keys, "_g"], at)), F.lit(0).cast("long")))
    return inner.join(base, same).select(*rows.columns, (F.col("_base") + F.col("_own")).alias(out))


# ---------------------------------------------------------------- word hashing

_CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NEAR = 64  # places in a word whose bytes have their number in a table


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _numbers(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A number of its own for each byte at each place of a word."""
    return mix64(mix64(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + byte.astype(np.uint64))


_TABLE = np.ascontiguousarray(_numbers(np.arange(_NEAR)[:, None], np.arange(256)[None, :]))
_TABLE[:, _SPACE] = 0


def _hash_piece(raw: np.ndarray) -> np.ndarray:
    """Words' hashes: the sum of their bytes' numbers, and the length, mixed. No algebra of places lets words collide by construction."""
    space = _SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    low = _LOWER[raw[start[0] :]]
    place = np.arange(len(low)) - np.repeat(start - start[0], np.diff(np.append(start, len(raw))))
    each = _TABLE[np.minimum(place, _NEAR - 1), low]
    far = np.flatnonzero((place >= _NEAR) & ~space[start[0] :])
    each[far] = _numbers(place[far], low[far])
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(each, start - start[0]) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased.

    Long texts are hashed piece by piece (cut at white space), so memory stays in
    proportion to one piece plus eight bytes a word.
    """
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= _CHUNK:
        return _hash_piece(raw)
    parts, at = [], 0
    while at < len(raw):
        to = min(at + _CHUNK, len(raw))
        while to < len(raw) and not _SPACE[raw[to]]:
            gap = np.flatnonzero(_SPACE[raw[to : to + _CHUNK]])
            to = to + int(gap[0]) if len(gap) else min(to + _CHUNK, len(raw))
        parts.append(_hash_piece(raw[at:to]))
        at = to
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, in text order; fewer words make one shingle; none, nothing."""
    if not len(words):
        return np.empty(0, np.uint64)
    take = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - take + 1, np.uint64(take * 0x632BE5AB + 1), np.uint64)
        for k in range(take):
            out = mix64(out * np.uint64(0x2545F4914F6CDD1D) + words[k : len(words) - take + 1 + k])
    return out
