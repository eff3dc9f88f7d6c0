"""Two-pass external shuffle into shards.

Pass 1 scatters the rows uniformly into memory-sized buckets by a seeded hash of
identifier and text. Pass 2 holds one bucket at a time, puts it in a canonical order
(so a rerun task gives the same result, however its rows arrive), applies a seeded
Fisher-Yates shuffle and writes it. The buckets in turn are one global order; shard s
of n is its s-th equal part, so shard sizes differ by one row at most (law ``rows``).

Nulls hash like any value; a null text has no bytes. Equal rows may land anywhere, as
each row has a slot of its own. A bucket that is far over its size - only many equal
(identifier, text) rows can make one - is dealt over more buckets by position in the
input. Beyond FAN buckets the rows are dealt in two turns: into FAN groups of buckets,
each written, then each group into its buckets, AT_ONCE groups side by side, so no shuffle
has more than FAN reducers.
An empty table gives no rows; a very long text is one row; all columns are carried in a
struct, so their names can't clash.
"""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialize, running_sums, scratch


#: Reducers of one shuffle at most.
FAN = 1 << 13
AT_ONCE = 16  # groups of buckets that are shuffled side by side


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n): swap each place, from the last, with one at or before it."""
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), (rng.random(max(0, n - 1)) * np.arange(n, 1, -1)).astype(np.int64).tolist(), strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def external_shuffle(docs: DataFrame, seed: int = 2024, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Shuffled rows, written: ``row`` (all columns of docs), ``bucket``, ``place`` (from 0 in its bucket)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in docs.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    weight = functools.reduce(lambda a, b: a + b, texts, F.lit(0).cast("long"))
    size = docs.agg(F.sum(weight + 64)).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    own = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(text))
    keyed = docs.select(whole.alias("row"), own.alias("h"), F.monotonically_increasing_id().alias("at"))
    home = F.pmod("h", F.lit(buckets)).cast("int")
    heavy = [r[0] for r in docs.select(own.alias("h"), weight.alias("b")).groupBy("h").agg((F.sum("b") + 64 * F.count("*")).alias("b"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("b") > 2 * bucket_bytes)).collect()]
    # a row of heavy stands for over two buckets of equal rows, so there are fewer than half as many as buckets
    if heavy:
        home = F.when(F.col("h").isin(heavy), F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(buckets)).cast("int")).otherwise(home)
    dealt = keyed.withColumn("bucket", home)

    def shuffle(batches):
        give_back()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        h, at, bucket = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("h", "at", "bucket"))
        for b in np.unique(bucket):
            mine = np.flatnonzero(bucket == b)
            mine = mine[np.lexsort((at[mine], h[mine]))]
            mine = mine[fisher_yates(len(mine), np.random.Generator(np.random.Philox([seed, int(b)])))]
            for k in range(0, len(mine), 4096):
                part = mine[k : k + 4096]
                rows = table.column("row").take(pa.array(part)).combine_chunks()
                yield pa.RecordBatch.from_arrays([rows if isinstance(rows, pa.Array) else rows.chunk(0), pa.array(np.full(len(part), b), pa.int32()), pa.array(np.arange(k, k + len(part)), pa.int64())], names=["row", "bucket", "place"])

    kind = T.StructType([keyed.schema["row"], T.StructField("bucket", T.IntegerType()), T.StructField("place", T.LongType())])
    if buckets <= FAN:
        return materialize(dealt.repartitionById(buckets, "bucket").mapInArrow(shuffle, kind), "shuffled")
    spark, path, each = docs.sparkSession, scratch(docs.sparkSession, "scattered"), -(-buckets // FAN)
    groups = -(-buckets // each)
    dealt.withColumn("g", F.expr(f"bucket div {each}").cast("int")).repartitionById(groups, "g").write.partitionBy("g").parquet(path)
    held, done = spark.read.schema(T.StructType([*dealt.schema, T.StructField("g", T.IntegerType())])).parquet(path), scratch(spark, "shuffled")

    def group(g: int) -> str:
        part = held.where(F.col("g") == g).drop("g").withColumn("own", F.col("bucket") - g * each).repartitionById(each, "own").drop("own")
        part.mapInArrow(shuffle, kind).write.parquet(f"{done}/{g}")
        return f"{done}/{g}"

    with ThreadPoolExecutor(AT_ONCE) as pool:  # a job a group of buckets, not a row; some side by side, so none waits for another's last task
        return spark.read.schema(kind).parquet(*pool.map(inheritable_thread_target(spark)(group), range(groups)))


def shard(docs: DataFrame, shards: int = 24, seed: int = 2024, bucket_bytes: int = 16 << 20) -> DataFrame:
    """``row`` with its ``shard`` and ``slot`` (gapless from 0 in the shard), by law ``rows``."""
    done = external_shuffle(docs, seed, bucket_bytes)
    held = done.groupBy("bucket").agg(F.count("*").alias("n"))  # a row a bucket
    held = running_sums(held, [], "bucket", "n", "base")
    base = held.join(held.agg(F.sum("n").alias("total")))
    out = done.join(base, "bucket").withColumn("shard", F.expr(f"cast((base + place) * {shards} div total as int)"))
    begin = F.expr(f"(shard * total + {shards - 1}) div {shards}")  # the first place whose shard is this one
    return out.select("row", "shard", (F.col("base") + F.col("place") - begin).alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, read from the written rows."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return shard(docs, shards).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
