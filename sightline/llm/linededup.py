"""Line dedup by range-partitioned hashes; decisions are keep bitmaps, not text.

Keys of lines (ends stripped of white space, A-Z lower-cased; ``least`` code points or
more) become 128-bit hashes. Each goes to the partition of its range of hashes, sorted
there by document and position, and one pass over a partition names each key's first
document; its lines elsewhere are dropped. A key with more than ``hot`` lines, and at
least a FITS-th of all, leaves that path (cells of hashes, whose number grows with the
lines, are counted first, then keys in crowded cells): its first document is a pre-aggregated minimum, so no task holds its lines.
Drops are gathered, a document at a time, as 64-bit words of a keep bitmap (bit i of
word w: line 64 w + i stays), of which only words with a cleared bit are kept.

Everything is DataFrame expressions. A null or empty text is one empty line. A null
doc_id is a document that comes after all others (rows without an id are one document
here), and rows that share a doc_id are one document in which each text has its own
bitmap; lines of the first document stay however often it has them. An empty table gives
no rows, a very long text is one array of lines, and columns other than doc_id and text
play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = (1 << 63) - 1
COARSE = 1 << 16
FITS = 1 << 19
#: Ranges of hashes at most; beyond, ranges grow, and their sorts spill.
MOST_PARTS = 1 << 15


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is the same and faster where all is ASCII
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, least: int = 10, rows_each: int = 250_000, hot: int = 60_000) -> DataFrame:
    """d (doc_id, the last number for null), tx (hash of the text), keep (word number -> keep bits): documents that lose lines."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("tx"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keyed = rows.withColumn("k", line_key(F.col("line"))).where(F.length("k") >= least)
    lines = materialize(keyed.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"), "d", "tx", "pos"), "lines")
    total = lines.count()
    hot = max(hot, total // FITS)  # so fewer than FITS cells or keys have more lines
    cell = F.pmod("h1", F.lit(1 << max(COARSE, 8 * total // hot).bit_length())).alias("c")  # an eighth of hot in a cell, if lines are spread evenly
    suspects = materialize(lines.groupBy(cell).agg(F.count("*").alias("n")).where(F.col("n") > hot).select("c"), "hot-cells")
    dropped, cold = [], lines
    if not suspects.isEmpty():
        few = lines.select("h1", "h2", "d", cell).join(F.broadcast(suspects), "c", "left_semi")
        heavy = materialize(few.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("d").alias("first")).where(F.col("n") > hot).drop("n"), "hot-lines")
        if not heavy.isEmpty():
            cold = lines.join(F.broadcast(heavy.select("h1", "h2")), ["h1", "h2"], "left_anti")
            dropped.append(lines.join(F.broadcast(heavy), ["h1", "h2"]).where("d <> first").select("d", "tx", "pos"))
    parts = max(1, min(MOST_PARTS, -(-total // rows_each)))
    part = F.least(F.lit(parts - 1), F.floor((F.col("h1").cast("double") / float(1 << 64) + 0.5) * parts)).cast("int")
    ranged = cold.withColumn("part", part).repartitionById(parts, "part")
    stream = Window.partitionBy("part", "h1", "h2").orderBy("d", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dropped.append(ranged.withColumn("first", F.first("d").over(stream)).where("d <> first").select("d", "tx", "pos"))
    gone = dropped[0] if len(dropped) == 1 else dropped[0].unionByName(dropped[1])
    gone = gone.repartition("d", "tx")  # serves both groupings
    words = gone.groupBy("d", "tx", F.expr("pos div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    return words.groupBy("d", "tx").agg(F.map_from_entries(F.collect_list(F.struct("w", F.bitwise_not("bits").alias("keep")))).alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that a keep bitmap leaves."""
    words = F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(lines) - 1) / 64).cast("int")), lambda w: F.coalesce(F.element_at(keep, w), F.lit(-1).cast("long")))
    return F.transform(F.array(words), lambda dense: F.filter(lines, lambda _, i: F.getbit(F.element_at(dense, (F.floor(i / 64) + 1).cast("int")), i % 64) == 1))[0]


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = docs.select("doc_id", "text")
    maps = keep_bitmaps(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("tx"), text.alias("text"))
    lines = text_lines(F.col("text"))
    out = rows.join(maps, ["d", "tx"], "left").withColumn("kept", F.when(F.col("keep").isNotNull(), kept_lines(lines, F.col("keep"))))
    n = F.size(lines).cast("long")
    return out.select(
        "doc_id", n.alias("n_lines"), F.when(F.col("kept").isNull(), F.lit(0).cast("long")).otherwise(n - F.size("kept")).alias("n_dropped"),
        F.sha2(F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).cast("binary"), 256).alias("kept_sha256"),
    )
