"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words;
no target exceeds ``repeats`` times its source, what is over goes to the others by
weight. Each source's documents, in a seeded random order, form an endless stream of
words, cut into blocks of B words. Slot i of the schedule goes to the source in whose
part of the cumulative weights the i-th golden-ratio point lies; the k-th slot of a
source takes the k-th block of its stream. A stream ends at its target, so every
source's words are its target rounded, and no document is taken more than ``repeats``
times; slots that a source still lacks after the schedule come at its end.

The hot source is never in one task: offsets are sums within (source, hash bucket)
plus the sums of the buckets before, which are summed in two levels; ranks likewise
within (source, run of slots). An empty table gives no rows; very long texts are counted
whole; only ``mixed_documents`` carries other columns, under any names. A null text has no words, and a document without words takes no part. Repeated rows
are documents of their own. Reruns agree: order and schedule depend on the seed and
the rows alone (documents that are equal in id, size and source may change places).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running_sums

WEIGHTS = (5, 2, 1)
GOLDEN = (5**0.5 - 1) / 2
RUN = 1 << 15  # slots whose ranks one task counts


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], repeats: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``repeats`` times its size."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        w = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / w > repeats * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in full)
        free -= full
    return out


class Mix:
    """``pieces``: a row of ``docs`` (uid) in a block: source number s, epoch, block, words."""

    def __init__(self, docs: DataFrame, repeats: int = 3, seed: int = 11, bucket_rows: int = 2_000):
        spark = docs.sparkSession
        light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
        self.light = light = materialize(light.withColumn("uid", F.monotonically_increasing_id()), "mix-sizes")
        # a row a source, not a document
        held = sorted(light.groupBy("source").agg(F.sum("size"), F.count("*")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
        self.names = [r[0] for r in held]
        self.sizes = [r[1] for r in held]
        rows = sum(r[2] for r in held)
        weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(held))]
        self.targets = targets(self.sizes, weights, repeats)
        self.words = [min(repeats * s, int(t + 0.5)) for s, t in zip(self.sizes, self.targets, strict=True)]
        self.block = max(16, min(1 << 20, sum(self.words) // (1 << 15)))
        source = "source string, s int, source_size long, target double, words long"
        self.sources = spark.createDataFrame(list(zip(self.names, range(len(held)), self.sizes, self.targets, self.words, strict=True)), source)
        self.placed = self._place(light, max(1, rows // bucket_rows))
        self.slots = self._schedule(spark)

    def _place(self, light: DataFrame, buckets: int) -> DataFrame:
        """Each document's first word in its source's stream (``begin``)."""
        rows = light.where("size > 0").join(self.sources, light.source.eqNullSafe(self.sources.source)).select("uid", "s", "size", "h", "doc_id", "source_size", "words")
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int"))
        sums = running_sums(rows.groupBy("s", "bucket").agg(F.sum("size").alias("held")), ["s"], "bucket", "held", "base").select("s", "bucket", "base")
        within = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("off", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long"))).join(sums, ["s", "bucket"]).select("uid", "s", "size", "source_size", "words", (F.col("base") + F.col("off")).alias("begin"))

    def _schedule(self, spark) -> DataFrame:
        """slot, s, block: the order of the mix. One row a block."""
        need, block = np.array([-(-w // self.block) for w in self.words], np.int64), self.block
        total = int(need.sum())
        edges = np.cumsum(np.array(self.words, float)) / max(1, sum(self.words))

        def draw(batches):
            for batch in batches:
                i = batch.column(0).to_numpy()
                u = np.modf((i + 0.5) * GOLDEN)[0]
                s = np.minimum(np.searchsorted(edges, u, side="right"), max(0, len(edges) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s.astype(np.int32))], names=["slot", "s"])

        drawn = spark.range(0, total, 1, max(1, total // (4 * RUN))).mapInArrow(draw, "slot long, s int").withColumn("run", F.expr(f"slot div {RUN}"))
        counts = drawn.groupBy("s", "run").agg(F.count("*").alias("n"))
        base = running_sums(counts, ["s"], "run", "n", "base").select("s", "run", "base")
        rank = F.row_number().over(Window.partitionBy("s", "run").orderBy("slot")) - 1
        ranked = drawn.withColumn("rank", rank).join(base, ["s", "run"]).select("slot", "s", (F.col("base") + F.col("rank")).alias("block"))
        got = {r[0]: r[1] for r in counts.groupBy("s").agg(F.sum("n")).collect()}
        lack = [(s, got.get(s, 0), int(n)) for s, n in enumerate(need) if got.get(s, 0) < n]
        if lack:
            ends = np.cumsum([b - a for _, a, b in lack]).tolist()  # slots of the tail, a source at a time
            rows = [(s, a, b, total + end - b) for (s, a, b), end in zip(lack, ends, strict=True)]
            tail = spark.createDataFrame(rows, "s int, a long, b long, base long").select("base", "s", F.explode(F.expr("sequence(a, b - 1)")).alias("block")).select((F.col("base") + F.col("block")).alias("slot"), "s", "block")
            ranked = ranked.unionByName(tail)
        return ranked

    def pieces(self) -> DataFrame:
        """slot, s, block, epoch, uid, words: what each slot of the mix takes of each document."""
        at = F.col("epoch") * F.col("source_size") + F.col("begin")
        live = self.placed.withColumn("epoch", F.explode(F.expr("sequence(0L, greatest(0L, (words - 1) div source_size))"))).withColumn("a", at).withColumn("b", F.least(at + F.col("size"), F.col("words"))).where("a < b")
        cut = live.withColumn("block", F.explode(F.expr(f"sequence(a div {self.block}, (b - 1) div {self.block})")))
        over = F.least("b", (F.col("block") + 1) * self.block) - F.greatest("a", F.col("block") * self.block)
        return cut.select("s", "block", "epoch", "uid", over.alias("n")).join(self.slots, ["s", "block"]).select("slot", "s", "block", "epoch", "uid", F.col("n").alias("words"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document."""
        sums = self.pieces().groupBy("uid").agg(F.sum("words").alias("taken"))
        light, s = self.light, self.sources
        return light.join(s, light.source.eqNullSafe(s.source)).join(sums, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, repeats: int = 3, seed: int = 11) -> DataFrame:
    """The columns of docs, a row as often as the mix begins to take the document (0 to ``repeats`` times), whole.

    Copies come back to the texts by id, text hash, size and source; rows alike in all are
    as many as the most taken of them.
    """
    columns, mix = docs.columns, Mix(docs, repeats, seed)
    copies = mix.pieces().select("uid", "epoch").distinct().groupBy("uid").agg(F.count("*").alias("copies"))
    most = mix.light.join(copies, "uid").groupBy("doc_id", "h", "size", "source").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")).withColumn("size", word_count(F.col("row.text").cast("string"))).withColumn("h", F.xxhash64(F.lit(seed), "row.doc_id", "row.text"))
    match = F.col("row.doc_id").cast("long").eqNullSafe(most.doc_id) & (rows["h"] == most["h"]) & (rows["size"] == most["size"]) & F.col("row.source").cast("string").eqNullSafe(most.source)
    out = rows.join(most, match).withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))")))
    return out.select(*[F.col(f"row.`{c}`") for c in columns])
