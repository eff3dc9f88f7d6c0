"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are scaled to integers, range-partitioned by length (then id, so that equal
lengths split) and packed into buckets of similar length. A first pass takes each
query's k-th best score in the longest bucket as its threshold. In every other bucket
threshold / (|q| * longest length) is the cosine a vector must reach there: above 1 the
bucket is skipped unread; a high one prunes by coordinates (each large coordinate of q
bounds the same coordinate of a unit vector at that cosine), a low one by length alone.
What is left is verified by exact integer products, and the best k of every bucket meet
in one last ranking. Ties go to the smaller vec_id.

Queries are rows of the table, in packed blocks that lie in files of the shared folder.
The longest bucket, of bounded size, goes to every task that packs queries. Buckets are
read once a group of GROUP blocks of queries, which come along as places in those files
and are kept while a task needs them; what multiplies is these numbers, not vectors. A
block of queries in a bucket returns at most k rows a query, however many vectors are
equal. An empty table gives no rows, and columns other than vec_id and embedding play no
part. Vectors that
are null, or hold a null or a non-finite component, and rows without vec_id take no part.
Missing components of a shorter vector count as 0. A row whose vec_id equals the query's
is the query's own. Scores beyond 64 bits are clipped to them.
"""

from __future__ import annotations

import struct
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, open_fs, scratch, small_batches

PACKED = "block long, lo double, hi double, n int, dims int, ids binary, vecs binary"
FITS = 1 << 19  # rows of four numbers that may be broadcast: 16 MB
FOUND = "q_block long, i int, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles that are whole numbers), norm; without rows that take no part."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024.0).cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def pack(rows: DataFrame, size: int, parts: int, name: str) -> DataFrame:
    """Blocks of up to ``size`` vectors, longest first within each range of lengths."""
    order = [F.col("norm").desc(), F.col("vec_id")]

    def run(batches):
        give_back()
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                lists = part.column(1).to_pylist()
                dims = max(map(len, lists), default=0)
                vecs = np.zeros((len(lists), dims))
                for i, x in enumerate(lists):
                    vecs[i, : len(x)] = x
                norms = part.column(2).to_numpy()
                yield pa.RecordBatch.from_pylist([{"lo": float(norms.min()), "hi": float(norms.max()), "n": len(lists), "dims": dims, "ids": part.column(0).to_numpy().astype("<i8").tobytes(), "vecs": vecs.tobytes()}], schema=pa.schema([("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary())]))

    blocks = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, PACKED.removeprefix("block long, "))
    return materialize(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), name)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: doubles where these are exact, else Python's integers."""
    d = min(q.shape[-1], v.shape[-1])
    q, v = q[..., :d], v[..., :d]
    if d == 0 or not len(v):
        return np.zeros(len(v))
    if d * np.abs(q).max() * np.abs(v).max() < 2**53:
        return v @ q
    whole = [int(x) for x in q.tolist()]
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in v.tolist()], object)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k])
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def candidates(q: np.ndarray, qn: float, unit: np.ndarray, norms: np.ndarray, theta: float, focus: int = 4) -> np.ndarray:
    """Places in a bucket (norms descending) that may reach theta."""
    if theta <= 0 or qn == 0 or not len(norms):
        return np.arange(len(norms)) if theta <= 0 or qn > 0 else np.empty(0, np.int64)
    local = theta / (qn * norms[0])
    if local > 1 + 1e-9:
        return np.empty(0, np.int64)
    long_enough = int(np.searchsorted(-norms, -(theta / qn) * (1 - 1e-9), side="right"))
    kept = np.arange(long_enough)
    if local < 0.3:
        return kept
    qu, c = q / qn, min(local, 1.0)
    for f in np.argsort(-np.abs(qu))[: min(focus, unit.shape[1])]:
        spread = np.sqrt(max(0.0, (1 - qu[f] ** 2) * (1 - c * c))) + 1e-9
        x = unit[kept, f]
        # cosines at or above c leave this much room; below the centre the bound falls to -1 only where c allows it
        low = qu[f] * c - spread if c > -qu[f] else -1.0
        high = qu[f] * c + spread if c > qu[f] else 1.0
        kept = kept[(x >= low) & (x <= high)]
    return kept


HEAD = struct.Struct("<qqq")  # block, queries, dimensions; then ids, thresholds, vectors
GROUP = 64


def packed_queries(block: int, ids: np.ndarray, theta: np.ndarray, q: np.ndarray) -> bytes:
    return HEAD.pack(block, *q.shape) + ids.tobytes() + theta.tobytes() + q.tobytes()


def read_queries(path: str, at: int, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    fs, name = open_fs(path)
    with fs.open_input_file(name) as file:
        raw = file.read_at(size, at)
    block, n, dims = HEAD.unpack_from(raw)
    ids, theta = np.frombuffer(raw, "<i8", n, HEAD.size), np.frombuffer(raw, "<f8", n, HEAD.size + 8 * n)
    return block, ids, theta, np.frombuffer(raw, "<f8", n * dims, HEAD.size + 16 * n).reshape(n, dims)


def clipped(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def prepared(queries: DataFrame, longest: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """Blocks of queries, written with their thresholds: path, grp, at, size, hi, least (their lowest threshold); GROUP blocks a group at most."""
    out, shared = scratch(queries.sparkSession, "topk-files"), queries.sparkSession.sparkContext.broadcast(longest)

    def run(batches):
        give_back()
        ids, v = shared.value
        sink, path, at, held = None, f"{out}/{uuid.uuid4().hex}", 0, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                q_ids, q = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vecs"]).reshape(r["n"], r["dims"])
                theta = np.full(len(q_ids), -np.inf)
                for i, x in enumerate(q):
                    others = np.flatnonzero(ids != q_ids[i])
                    if len(others) >= k:
                        scores = products(x, v[others])
                        theta[i] = clipped(scores[best(ids[others], scores, k)[-1]])
                raw = packed_queries(r["block"], q_ids, theta, q)
                if sink is None:
                    fs, name = open_fs(path)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(name, compression=None)
                sink.write(raw)
                rows.append({"path": path, "grp": held // GROUP, "at": at, "size": len(raw), "hi": r["hi"], "least": float(theta.min())})
                at, held = at + len(raw), held + 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("grp", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("hi", pa.float64()), ("least", pa.float64())]))
        if sink is not None:
            sink.close()

    return materialize(queries.mapInArrow(run, "path string, grp int, at long, size long, hi double, least double"), "topk-refs")


def _search(k: int):
    def run(batches):
        give_back()
        kept: OrderedDict = OrderedDict()
        last = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["block"] != last:
                    ids, v = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vecs"]).reshape(r["n"], r["dims"])
                    norms, last = np.sqrt((v * v).sum(1)), r["block"]
                    unit = v / np.maximum(norms, 1e-300)[:, None]
                for ref in r["refs"]:
                    if r["hi"] * ref["hi"] * (1 + 1e-9) < ref["least"]:
                        continue
                    place = r["path"], ref["at"]
                    if place not in kept:
                        kept[place] = read_queries(r["path"], ref["at"], ref["size"])
                        if len(kept) > 2 * GROUP:
                            kept.popitem(last=False)
                    block, q_ids, theta, q = kept[place]
                    width = max(v.shape[1], q.shape[1])
                    one, wide = np.pad(unit, ((0, 0), (0, width - v.shape[1]))), np.pad(q, ((0, 0), (0, width - q.shape[1])))
                    for i, x in enumerate(wide):
                        some = candidates(x, float(np.sqrt(x @ x)), one, norms, float(theta[i]))
                        some = some[ids[some] != q_ids[i]]
                        if not len(some):
                            continue
                        scores = products(q[i], v[some])
                        for at in best(ids[some], scores, k):
                            score = clipped(scores[at])
                            if score >= theta[i]:
                                rows.append((block, i, int(q_ids[i]), int(ids[some][at]), score))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["q_block", "i", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, bucket: int = 2048, query_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: of every vec_id divisible by ``every``, against all rows."""
    spark = vectors.sparkSession
    rows = quantised(vectors.select("vec_id", "embedding"))
    n = vectors.count()
    blocks = pack(rows, bucket, max(1, n // (4 * bucket)), "topk-buckets")
    queries = pack(rows.where(F.col("vec_id") % every == 0), query_block, max(1, n // every // (4 * query_block)), "topk-queries")
    first = blocks.orderBy(F.col("hi").desc(), "block").select("ids", "vecs", "n", "dims").head()  # one bucket
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = np.frombuffer(bytes(first.ids), "<i8"), np.frombuffer(bytes(first.vecs)).reshape(first.n, first.dims)
    with small_batches(spark, 16):  # rows of packed vectors
        refs = prepared(queries, longest, k)
        groups = refs.groupBy("path", "grp").agg(F.max("hi").alias("q_hi"), F.min("least").alias("least"), F.collect_list(F.struct("at", "size", "hi", "least")).alias("refs"))
        # which buckets can matter at all to a group, from lengths alone
        spread = blocks.repartition(max(1, n // bucket), "block")
        work = spread.join(F.broadcast(groups) if refs.count() <= FITS else groups, F.col("hi") * F.col("q_hi") * (1 + 1e-9) >= F.col("least")).select("block", "ids", "vecs", "n", "dims", "hi", "path", "refs")
        found = materialize(work.mapInArrow(_search(k), FOUND), "topk-found")
    rank = F.row_number().over(Window.partitionBy("q_block", "i").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
