"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

Texts are lower-cased words: runs of letters and digits, and single letters of scripts
without blanks (Han, kana, Thai and their neighbours). Seeds are windows of ``least``
words, of shorter items the whole item. The benchmark's seeds are a table; documents are
read once, and those seeds of theirs that pass a filter of the table's (bits of bounded
number, built where the table lies) are joined with it. A document that shares seeds with
an item, enough to cover ``share`` of it, is tiled against it: the longest window of
unmarked words common to both is marked in both, again and again, down to the item's
least length; equal lengths are found by rolling hashes and checked word by word. The
item leaks where tiles cover ``share`` of its words, in whatever order they stand.

Neither benchmark nor documents come to the driver. The seed table is broadcast only if
it was counted to fit; else the seeds meet in a shuffle, where a seed that many documents
share is a key that Spark splits (its rows are two numbers each).

Nulls and empty texts leak nothing, nor do items without words or without an id. Repeated
rows and items each count. Rows come back only for leaks, one for each document and item.
An empty table, of either, gives no leaks; a very long text is one array of hashes. Columns
other than doc_id and text (item_id and text) may have any name: ``clean`` carries them in
a struct.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, mix64, shingle_hashes, small_batches, word_hashes

#: Letters that are words of their own, and runs of all others.
ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORD = re.compile(f"[{ALONE}]|[^\\W_{ALONE}]+")
FITS = 1 << 19
#: Bits of the filter of seeds at most (16 MB), and at least.
MOST_BITS, LEAST_BITS = 1 << 27, 1 << 16
_INV = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
LEAKS = "doc_id long, item_id long, coverage double, tiles int, covered int, item_words int"


def words(text: str | None) -> np.ndarray:
    return word_hashes(" ".join(WORD.findall(text.lower()))) if text else np.empty(0, np.uint64)


class Rolling:
    """Karp-Rabin hashes of all windows of any one length, from one table of running sums."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens) + 1
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, 0x9E3779B97F4A7C15, np.uint64)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INV, np.uint64)]))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens * up[:-1])])

    def windows(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n]


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in doc, place in item, length), longest first; ties leftmost in doc, then item."""
    a, b, tiles = Rolling(doc), Rolling(item), []
    free_a, free_b = np.ones(len(doc), np.int64), np.ones(len(item), np.int64)

    def common(n: int):
        if n > min(len(doc), len(item)):
            return None
        open_a = np.flatnonzero(_all_free(free_a, n))
        open_b = np.flatnonzero(_all_free(free_b, n))
        if not len(open_a) or not len(open_b):
            return None
        ha, hb = a.windows(n)[open_a], b.windows(n)[open_b]
        hit = np.isin(ha, hb)
        return (open_a[hit], ha[hit], open_b, hb) if hit.any() else None

    most = min(len(doc), len(item))
    while True:
        low, high = least - 1, most
        while low < high:  # a common window of n words holds one of n - 1
            mid = (low + high + 1) // 2
            low, high = (mid, high) if common(mid) else (low, mid - 1)
        if low < least:
            return tiles
        at_a, ha, at_b, hb = common(low)
        spots: dict[int, list[int]] = {}
        for j, h in zip(at_b.tolist()[::-1], hb.tolist()[::-1], strict=True):
            spots.setdefault(h, []).append(j)
        marked = 0
        for i, h in zip(at_a.tolist(), ha.tolist(), strict=True):
            if not free_a[i : i + low].all():
                continue
            left = spots.get(h, [])
            while left:
                j = left.pop()
                if free_b[j : j + low].all() and (doc[i : i + low] == item[j : j + low]).all():
                    tiles.append((i, j, low))
                    free_a[i : i + low] = free_b[j : j + low] = 0
                    marked += 1
                    break
        most = low if marked else low - 1


def _all_free(free: np.ndarray, n: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(free)])
    return sums[n:] - sums[:-n] == n


def item_seeds(words_: np.ndarray, least: int) -> np.ndarray:
    """Seeds of an item at its places; of fewer than ``least`` words, one."""
    return shingle_hashes(words_, min(least, len(words_))) if len(words_) else np.empty(0, np.uint64)


def seed_table(benchmark: DataFrame, least: int) -> DataFrame:
    """item (a number of its own), item_id, n (words), place, size (words of a seed), seed: of all items with words and an id."""

    def run(batches):
        give_back()
        for batch in batches:
            cols = [[], [], [], [], [], []]
            for item, item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                w = words(text.as_py())
                seeds = item_seeds(w, least)
                k = len(seeds)
                for c, x in zip(cols, (np.full(k, item), np.full(k, item_id), np.full(k, len(w)), np.arange(k), np.full(k, min(least, len(w))), seeds.view(np.int64)), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t), from_pandas=False) for c, t in zip(cols, (np.int64, np.int64, np.int32, np.int32, np.int32, np.int64), strict=True)], names=["item", "item_id", "n", "place", "size", "seed"])

    rows = items_of(benchmark).select("item", "item_id", "text")
    return materialize(rows.mapInArrow(run, "item long, item_id long, n int, place int, size int, seed long"), "leak-seeds")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a hash of id and text), item_id, text, times: items with text and an id, those alike once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    return rows.groupBy("item_id", "text").agg(F.count("*").alias("times")).select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text", "times")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bitmap of the seeds' hashes, put together from parts: its size is bounded."""
    n = seeds.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, n) - 1).bit_length()))

    def run(batches):
        give_back()
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = mix64(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        for k in range(0, len(held), PART):
            if held[k : k + PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([held[k : k + PART].tobytes()], pa.binary())], names=["at", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in seeds.select("seed").coalesce(FILTER_PARTS).mapInArrow(run, "at int, bits binary").toLocalIterator():  # FILTER_PARTS bitmaps, a part of one at a time
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["at"] : r["at"] + len(part)] |= part
    return out


PART, FILTER_PARTS = 1 << 20, 64


def keyed(docs: DataFrame) -> DataFrame:
    """d (doc_id), tx (hash of the text), text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("tx"), text.alias("text"))


def suspects(docs: DataFrame, seeds: DataFrame, share: float) -> DataFrame:
    """d, tx, item: documents and items that share seeds enough."""
    spark = docs.sparkSession
    sizes = [r[0] for r in seeds.select("size").distinct().collect()]  # ``least`` numbers at most
    held = spark.sparkContext.broadcast(seed_filter(seeds))

    def run(batches):
        give_back()
        mask = np.uint64(len(held.value) * 8 - 1)
        for batch in batches:
            cols = [[], [], []]
            for d, tx, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                w = words(text.as_py())
                own = [shingle_hashes(w, n) for n in sizes if len(w) >= n]
                if not own:
                    continue
                own = np.concatenate(own)
                at = mix64(own) & mask
                hit = np.unique(own[(held.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                cols[0] += [d] * len(hit)
                cols[1].append(np.full(len(hit), tx))
                cols[2].append(hit.view(np.int64))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(np.concatenate(cols[1]), pa.int64()), pa.array(np.concatenate(cols[2]), pa.int64())], names=["d", "tx", "seed"])

    with small_batches(spark):
        found = materialize(keyed(docs).where("text is not null").mapInArrow(run, "d long, tx long, seed long"), "leak-hits").distinct()
    table = F.broadcast(seeds) if seeds.count() <= FITS else seeds
    met = found.join(table, "seed").groupBy("d", "tx", "item").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("size").alias("size"))
    # tiles lie within windows that are shared, and each of these covers ``size`` words at most
    return materialize(met.where(F.col("k") * F.col("size") >= share * F.col("n")).select("d", "tx", "item"), "leak-suspects")


def fitting(df: DataFrame) -> DataFrame:
    """With a broadcast hint if it has been counted to fit."""
    return F.broadcast(df) if df.count() <= FITS else df


def same(a: DataFrame, b: DataFrame) -> Column:
    return a.d.eqNullSafe(b.d) & (a.tx == b.tx)


LEAKS = "d long, tx long, item_id long, times long, coverage double, tiles int, covered int, item_words int"


def found_leaks(docs: DataFrame, benchmark: DataFrame, least: int, share: float) -> DataFrame:
    """d, tx and a leak: a row for each item that a text of this id and hash leaks; ``times`` items are alike."""
    seeds = seed_table(benchmark, least)
    pairs = suspects(docs, seeds, share)
    some = pairs.select("d", "tx").distinct()
    texts = keyed(docs)
    texts = texts.join(fitting(some), same(texts, some), "left_semi").dropDuplicates(["d", "tx"])
    some = items_of(benchmark)
    work = texts.join(pairs.withColumnRenamed("d", "e").withColumnRenamed("tx", "ex"), texts.d.eqNullSafe(F.col("e")) & (texts.tx == F.col("ex"))).join(some.withColumnRenamed("text", "own"), "item").select("d", "tx", "text", "item_id", "own", "times")

    def run(batches):
        give_back()
        last, doc = None, None
        for batch in batches:
            got = []
            for d, tx, text, item_id, own, times in zip(*(batch.column(i) for i in range(6)), strict=True):
                d, tx = d.as_py(), tx.as_py()
                if (d, tx) != last:
                    last, doc = (d, tx), words(text.as_py())
                item = words(own.as_py())
                tiles = tile(doc, item, min(least, len(item)))
                covered = sum(n for *_, n in tiles)
                if covered >= share * len(item):
                    got.append((d, tx, item_id.as_py(), times.as_py(), covered / len(item), len(tiles), covered, len(item)))
            if got:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=[f.split()[0] for f in LEAKS.split(", ")])

    with small_batches(docs.sparkSession):
        return materialize(work.mapInArrow(run, LEAKS), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """A row for each document and benchmark item of which it holds ``share`` or more."""
    found = found_leaks(docs, benchmark, least, share)
    rows = keyed(docs).select("d", "tx")
    each = rows.join(fitting(found), same(rows, found)).select(rows.d.alias("doc_id"), *[found[c] for c in ("item_id", "times", "coverage", "tiles", "covered", "item_words")])
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times", "copy")


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """The rows of docs that leak no item."""
    columns = docs.columns
    bad = found_leaks(docs, benchmark, least, share).select("d", "tx").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("tx"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    return rows.join(fitting(bad), same(rows, bad), "left_anti").select(*[F.col(f"row.`{c}`") for c in columns])
