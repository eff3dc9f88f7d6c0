"""Hard negatives by two-dimensional block matrix multiplication (SUMMA).

Rows are sorted by label and packed into blocks; each block is cut into chunks of
dimensions. Anchor blocks meet row blocks in the cells of a grid, (group of row blocks,
group of anchor blocks, chunk), about ``GROUP`` blocks a side whatever the labels are: row
blocks are dealt along one axis, anchor blocks along the other. A cell gives partial int64 score tiles; the tiles of all chunks meet
by (anchor block, row block), are added, and reduced at once to the few scores that can
matter. Two rounds share no product:

* positives: tiles whose label ranges overlap; of each, an anchor's first ``positives``
  rows of its own label;
* negatives: all tiles but those of one single label; of each, the first ``negatives``
  scores in the window of every (anchor, positive), its bounds brought by the anchors.

What the driver holds are two counts. Intermediate rows are tiles and a bounded number of
scores a tile; no pairs of rows are written out. Tiles are packed by byte planes, so int64
scores cost the bytes that they use.

Nulls: rows without vec_id, label or vector, or with a null or non-finite component take
no part. A row whose vec_id equals the anchor's is the anchor's own; repeated rows are
candidates each, and each repeated anchor row gives its own result rows. Missing
components of a shorter vector, also of an empty one, count as 0. Components beyond 64
bits are clipped to them; products are exact, in big integers where int64 might not hold
them, then clipped to 64 bits, before any comparison. Ties go to the smaller vec_id. A
positive of negative score has an empty window.
An empty table gives no rows; columns beside vec_id, label and embedding play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, small_batches
from .topk import best

GROUP = 16  # blocks a side in a cell of the grid, about
BIG = 48  # bytes of a big integer in a tile
BLOCK = "chunk int, n int, dims int, lo long, hi long, top double, ids binary, labels binary, vecs binary"
WINDOWS = "array<struct<i:int,p:int,positive_id:long,positive_score:long,lo:long,hi:long>>"
TILE = f"a_block long, r_block long, chunk int, kind string, tile binary, heads binary, rows binary, windows {WINDOWS}"
BEST = "a_block long, i int, anchor_id long, p int, positive_id long, positive_score long, vec_id long, score long"
_BLOCK = pa.schema([("chunk", pa.int32()), ("n", pa.int32()), ("dims", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("top", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vecs", pa.binary())])
_BEST = pa.schema([("a_block", pa.int64()), ("i", pa.int32()), ("anchor_id", pa.int64()), ("p", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(rows: DataFrame, scale: int, label: Column) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    edge = float(2**63 - 1024)
    v = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * float(scale), F.lit(-edge)), F.lit(edge))))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ok)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))


def blocks(rows: DataFrame, size: int, chunk: int, parts: int, name: str) -> DataFrame:
    """Rows sorted by label, ``size`` a block, a block a record for each ``chunk`` dimensions; ids and labels lie in chunk 0."""
    order = ["label", F.xxhash64("vec_id"), "vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                ids, labels = (np.ascontiguousarray(part.column(c).to_numpy(), "<i8") for c in (0, 1))
                lists = part.column(2).to_pylist()
                dims = max(1, max(map(len, lists)))
                v = np.zeros((len(lists), dims), np.int64)
                for i, x in enumerate(lists):
                    v[i, : len(x)] = x
                one = {"n": len(ids), "lo": int(labels.min()), "hi": int(labels.max()), "top": float(np.abs(v.astype(np.float64)).max() * np.sqrt(dims))}
                pieces = [v[:, at : at + chunk] for at in range(0, dims, chunk)]
                yield pa.RecordBatch.from_pylist([one | {"chunk": c, "dims": x.shape[1], "ids": b"" if c else ids.tobytes(), "labels": b"" if c else labels.tobytes(), "vecs": x.astype("<i8").tobytes()} for c, x in enumerate(pieces)], schema=_BLOCK)

    cut = rows.select("vec_id", "label", "v").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the chunks of a block come one after another: its number is that of its first chunk
    return materialize(cut.mapInArrow(run, BLOCK).select((F.monotonically_increasing_id() - F.col("chunk")).alias("block"), "*"), name)


def pack_tile(tile: np.ndarray) -> tuple[str, bytes]:
    if tile.dtype == object:
        return "big", b"".join(int(x).to_bytes(BIG, "little", signed=True) for x in tile.ravel())
    near_zero = (tile << 1) ^ (tile >> 63)  # the sign is the lowest bit, so small scores leave the high bytes empty
    planes = np.ascontiguousarray(near_zero.reshape(-1, 1).view(np.uint8).T)
    return "int64", pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def read_tile(kind: str, raw: bytes, shape: tuple[int, int]) -> np.ndarray:
    if kind == "big":
        return np.array([int.from_bytes(raw[k : k + BIG], "little", signed=True) for k in range(0, len(raw), BIG)], object).reshape(shape)
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, 8 * shape[0] * shape[1], asbytes=True), np.uint8).reshape(8, -1)
    near_zero = np.ascontiguousarray(planes.T).view("<u8").reshape(shape)
    return (near_zero >> np.uint64(1)).view("<i8") ^ -(near_zero & np.uint64(1)).view("<i8")


def product(q: np.ndarray, v: np.ndarray, top: float) -> np.ndarray:
    """q times v transposed, exact: doubles where they hold every sum, int64, or big integers; ``top`` bounds the whole scores."""
    d = min(q.shape[1], v.shape[1])
    q, v = q[:, :d], v[:, :d]
    if top < 2**52:
        return np.ascontiguousarray(q.astype(np.float64) @ v.astype(np.float64).T).astype("<i8")
    return np.ascontiguousarray(q @ v.T).astype("<i8") if top < 2**62 else q.astype(object) @ v.astype(object).T


def partial_tiles(rows: DataFrame, anchors: DataFrame, meet: str) -> DataFrame:
    """Partial score tiles of every (anchor block, row block, chunk) for which ``meet`` holds, as r and a; chunk 0 is there on both sides always."""
    groups = [max(1, -(-side.where("chunk = 0").count() // GROUP)) for side in (rows, anchors)]
    axis = lambda of, at: F.pmod(F.xxhash64(of), F.lit(groups[at])).cast("int")
    every = lambda at: F.explode(F.sequence(F.lit(0), F.lit(groups[at] - 1)))
    r = rows.withColumn("g", axis("block", 0)).withColumn("h", every(1)).alias("r")
    a = anchors.withColumn("h", axis("block", 1)).withColumn("g", every(0)).alias("a").hint("merge")
    met = r.join(a, F.expr(f"r.g = a.g AND r.h = a.h AND r.chunk = a.chunk AND {meet}"))
    chosen = ["a.block", "a.n", "a.dims", "a.top", "a.ids", "a.labels", "a.vecs", "a.windows", "r.block", "r.n", "r.dims", "r.top", "r.ids", "r.labels", "r.vecs", "r.chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for k in range(batch.num_rows):
                get = {name: batch.column(name)[k] for name in batch.schema.names}
                x = {name: value.as_py() for name, value in get.items() if name != "a_windows"}
                q = np.frombuffer(x["a_vecs"], "<i8").reshape(x["a_n"], x["a_dims"])
                v = np.frombuffer(x["r_vecs"], "<i8").reshape(x["r_n"], x["r_dims"])
                kind, tile = pack_tile(product(q, v, x["a_top"] * x["r_top"]))
                cols = [pa.array([x["a_block"]]), pa.array([x["r_block"]]), pa.array([x["r_chunk"]], pa.int32()), pa.array([kind]), pa.array([tile]), pa.array([x["a_ids"] + x["a_labels"]]), pa.array([x["r_ids"] + x["r_labels"]]), batch.column("a_windows").slice(k, 1)]
                yield pa.RecordBatch.from_arrays(cols, names=["a_block", "r_block", "chunk", "kind", "tile", "heads", "rows", "windows"])

    return met.select(*[F.col(c).alias(c.replace(".", "_")) for c in chosen]).mapInArrow(run, TILE)


def reduced(tiles: DataFrame, pick) -> DataFrame:
    """Adds the partial tiles of each (anchor block, row block); ``pick(tile, heads, rows, windows)`` gives what is left of a whole tile, as rows of BEST after a_block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        key = whole = None

        def done():
            limit = 1 << 63
            tile = np.array([[max(-limit, min(limit - 1, x)) for x in row] for row in whole], np.int64).reshape(whole.shape) if whole.dtype == object else whole
            found = pick(tile, heads, rows, windows)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((key[0], *f) for f in found), strict=True), _BEST, strict=True)], schema=_BEST) if found else None

        for batch in batches:
            for x in batch.to_pylist():
                if (x["a_block"], x["r_block"]) != key:
                    if key is not None and (out := done()) is not None:
                        yield out
                    key, windows = (x["a_block"], x["r_block"]), x["windows"]  # chunk 0 comes first
                    heads, rows = (np.frombuffer(x[c], "<i8").reshape(2, -1) for c in ("heads", "rows"))
                    whole = read_tile(x["kind"], x["tile"], (heads.shape[1], rows.shape[1]))
                else:
                    whole = whole + read_tile(x["kind"], x["tile"], whole.shape)
        if key is not None and (out := done()) is not None:
            yield out

    met = tiles.repartition("a_block", "r_block").sortWithinPartitions("a_block", "r_block", "chunk")
    return met.mapInArrow(run, BEST)


def mine(rows: DataFrame, label: Column | None = None, scale: int = 256, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, size: int = 4096, anchor_size: int = 256, chunk: int = 32) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, embedding; anchors are rows whose vec_id is divisible by
    ``every``. A negative scores from ``least`` to ``most`` percent of the positive.
    """
    spark = rows.sparkSession
    ready = quantised(rows.select("vec_id", "label", "embedding"), scale, F.col("label") if label is None else label)
    n = rows.count()
    with small_batches(spark, size):
        all_rows = blocks(ready, size, chunk, max(1, n // (4 * size)), "hardneg-rows")
    with small_batches(spark, anchor_size):
        anchors = blocks(ready.where(F.col("vec_id") % every == 0), anchor_size, chunk, max(1, n // every // (4 * anchor_size)), "hardneg-anchors")

    def place(*partition: str) -> Column:
        return F.row_number().over(Window.partitionBy(*partition).orderBy(F.col("score").desc(), "vec_id"))

    def pick_positives(tile, heads, rows, windows):
        out = []
        for i, (anchor, own) in enumerate(heads.T):
            some = np.flatnonzero((rows[1] == own) & (rows[0] != anchor))
            if len(some):
                out += [(i, int(anchor), 0, None, None, int(rows[0, some[k]]), int(tile[i, some[k]])) for k in best(rows[0, some], tile[i, some], positives)]
        return out

    def pick_negatives(tile, heads, rows, windows):
        out = []
        for w in windows or []:
            i = w["i"]
            some = np.flatnonzero((rows[1] != heads[1, i]) & (tile[i] >= w["lo"]) & (tile[i] <= w["hi"]))
            if len(some):
                out += [(i, int(heads[0, i]), w["p"], w["positive_id"], w["positive_score"], int(rows[0, some[k]]), int(tile[i, some[k]])) for k in best(rows[0, some], tile[i, some], negatives)]
        return out

    with small_batches(spark, 8):  # rows of packed blocks and tiles
        plain = anchors.withColumn("windows", F.lit(None).cast(WINDOWS))
        same = reduced(partial_tiles(all_rows, plain, "a.lo <= r.hi AND a.hi >= r.lo"), pick_positives)
        near = same.withColumn("p", place("a_block", "i")).where(F.col("p") <= positives)
        window = F.struct("i", "p", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr(_at_least("score", least)).alias("lo"), F.expr(_at_most("score", most)).alias("hi"))
        windows = near.where("score >= 0").groupBy("a_block").agg(F.collect_list(window).cast(WINDOWS).alias("windows"))  # at most ``positives`` an anchor of the block
        windows = materialize(windows, "hardneg-windows")
        dressed = anchors.join(windows, (F.col("block") == F.col("a_block")) & (F.col("chunk") == 0), "left").drop("a_block")
        other = reduced(partial_tiles(all_rows, dressed, "NOT (a.lo = a.hi AND r.lo = r.hi AND a.lo = r.lo)"), pick_negatives)
        found = materialize(other, "hardneg-found")
    ranked = found.withColumn("rank", place("a_block", "i", "p")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _at_least(score: str, percent: int) -> str:
    """The least whole number that is ``percent`` of a score of 0 or more, without leaving 64 bits."""
    return f"{score} div 100 * {percent} + ({score} % 100 * {percent} + 99) div 100"


def _at_most(score: str, percent: int) -> str:
    return f"{score} div 100 * {percent} + {score} % 100 * {percent} div 100"
