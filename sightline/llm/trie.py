"""Conversation prefix trie by preorder intervals.

Every conversation is rebuilt (its base's first turns, then its own), and every prefix of
a rebuilt one is a node, known by the exclusive or of its turns' hashes at their places
(two of 64 bits each), so that prefixes of one very long conversation are summed in
groups of ``GROUP`` turns.

Nodes in a row that have the same members (one child, and no conversation ends between)
are a *chain*, known by its smallest member and number of members; conversations end and
branch at last nodes only. Chains are ranked in the lexicographic order of their path of
turn digests, written with the digest at each chain's head alone; a conversation passes b
chains only where b others of up to b turns leave it, so these paths stay in proportion
to the table. A chain's descendants stand right behind it: its rank and subtree size are
its interval, and leaves and savings are differences of prefix sums, which are taken by
range partition and then over one row a partition. A node adds what lies above it in its
chain.

No task takes a group that grows with the table: joins that meet a node or chain of many
rows take the few heavy ones (by their exact counts) from a broadcast of at most ``HEAVY``
rows and deal the rest by key; the conversations that end at one node are written out as
sorted pieces, and the digest of a node streams over its pieces.

Turns are ordered by turn (null first), then role, then digest of role and text; repeated
rows are turns each. Null role or text is empty. Rows without conv_id take no part; a
conversation is any other conv_id. Two turns are alike where role and text are; they are
told apart by MD5 of both. An empty table gives no rows, not even a root. Very long texts
are read by the JVM's digest alone; columns beside the four play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

GROUP = 4096  # turns of a conversation that one window orders
HEAVY = 10_000  # rows of a broadcast
LIGHT = 50_000  # rows of one key that a task may take anyway
SHARED = 8  # turns of its base that a conversation may begin with: its hash modulo one more
PIECE = 8192  # conversation ids in a piece
NODE = ["depth", "x1", "x2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, digest, size; without texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))


def numbered(rows: DataFrame, key: str, order: list, out: str, name: str) -> DataFrame:
    """Adds ``out``: the row's place from 1 within ``key``. A key of many rows lies in many range partitions."""
    keys = [F.col(key), *order, F.monotonically_increasing_id()]  # rows alike in all are told apart, to be split
    sorted_ = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(key, *order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), name)
    before = Window.partitionBy("_k").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = sorted_.groupBy(F.col(key).alias("_k"), F.col("_p").alias("_q")).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    base = base.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")))
    met = sorted_.join(base, (F.col(key) == F.col("_k")) & (F.col("_p") == F.col("_q")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_i") - F.col("_first") + 1).alias(out))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, convs). path: conv, depth, digest, size of every rebuilt turn; convs: conv, n_turns of every rebuilt conversation."""
    turns = materialize(numbered(turns_of(conversations), "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "pos", "trie-turns").select("conv", "pos", "digest", "size"), "trie-numbered")
    heads = turns.where(f"pos <= {SHARED} AND conv % 5 = 0").groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("heads"))
    own = turns.groupBy("conv").agg(F.max("pos").alias("own")).withColumn("base", F.expr("conv - conv % 5")).withColumn("h", F.expr(f"CAST(crc32(CAST(CAST(conv AS STRING) AS BINARY)) % {SHARED + 1} AS INT)"))
    convs = own.join(heads, "base", "left").withColumn("heads", F.expr("CASE WHEN h > 0 THEN slice(heads, 1, h) END"))
    convs = convs.select("conv", "own", "h", "heads", F.expr("CAST(coalesce(size(heads), 0) AS LONG)").alias("taken"))
    convs = materialize(convs.withColumn("n_turns", F.expr("taken + greatest(own - h, 0)")), "trie-convs")
    first = convs.select("conv", F.explode("heads").alias("t")).select("conv", F.col("t.pos").alias("depth"), "t.digest", "t.size")
    cut = lambda pos: F.expr(f"({pos} - 1) div {GROUP}")
    many = convs.select(F.col("conv").alias("_c"), "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), cut("own"))).alias("_g"))
    met = turns.withColumn("_t", cut("pos")).join(many, (F.col("conv") == F.col("_c")) & (F.col("_t") == F.col("_g"))).where("pos > h")
    rest = met.select("conv", F.expr("taken + pos - h").alias("depth"), "digest", "size")
    return first.unionByName(rest), convs.select("conv", "n_turns")


def paths(path: DataFrame) -> DataFrame:
    """Adds x1, x2 (the prefix that ends here) and upto (bytes of its texts)."""
    rows = path.withColumn("_g", F.expr(f"(depth - 1) div {GROUP}")).withColumn("_1", F.xxhash64(F.lit(1), "depth", "digest")).withColumn("_2", F.xxhash64(F.lit(2), "digest", "depth"))
    zero = F.lit(0).cast("long")
    totals = rows.groupBy(F.col("conv").alias("_c"), F.col("_g").alias("_h")).agg(F.bit_xor("_1").alias("_s1"), F.bit_xor("_2").alias("_s2"), F.sum("size").alias("_s3"))
    before = Window.partitionBy("_c").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_c", "_h", F.bit_xor("_s1").over(before).alias("_b1"), F.bit_xor("_s2").over(before).alias("_b2"), F.sum("_s3").over(before).alias("_b3")).where("_h > 0")
    w = Window.partitionBy("conv", "_g").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("_o1", F.bit_xor("_1").over(w)).withColumn("_o2", F.bit_xor("_2").over(w)).withColumn("_o3", F.sum("size").over(w))
    met = inner.join(base, (F.col("conv") == F.col("_c")) & (F.col("_g") == F.col("_h")), "left")
    whole = lambda k: F.coalesce(f"_b{k}", zero)
    return met.select("conv", "depth", "digest", "size", F.col("_o1").bitwiseXOR(whole(1)).alias("x1"), F.col("_o2").bitwiseXOR(whole(2)).alias("x2"), (F.col("_o3") + whole(3)).alias("upto"))


def join_heavy(many: DataFrame, few: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """many joined with few, whose ``keys`` are unique and whose ``weight`` is the number of rows of many with them.

    The weights sum to ``total`` at most, so at most HEAVY rows of few weigh more than
    total / HEAVY: these are broadcast. What is dealt by key has less a key.
    """
    limit = max(LIGHT, total // HEAVY)
    heavy, light = few.where(F.col(weight) > limit), few.where(F.col(weight) <= limit)
    by_key = many.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return many.join(F.broadcast(heavy), keys).unionByName(by_key)


def ordered_sums(rows: DataFrame, order: str, sums: dict[str, str], name: str) -> DataFrame:
    """Adds ``rank`` (from 0 in the order) and, for each name in ``sums``, the sum of its expression over the rows before (name) and up to here (name_to)."""
    sorted_ = materialize(rows.repartitionByRange(order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), name)
    each = {"rank": "1"} | sums
    base = sorted_.groupBy("_p").agg(*[F.sum(F.expr(e).cast("long")).alias(f"_s_{k}") for k, e in each.items()])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range partition
    base = base.select(F.col("_p").alias("_q"), *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0).cast("long")).alias(f"_b_{k}") for k in each])
    w = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    inner = sorted_.select("*", *[F.sum(F.expr(e).cast("long")).over(w).alias(f"{k}_to") for k, e in each.items()])
    met = inner.join(F.broadcast(base), F.col("_p") == F.col("_q"))
    upto = {k: F.col(f"{k}_to") + F.col(f"_b_{k}") for k in each}
    out = met.select(*rows.columns, *[upto[k].alias(f"{k}_to") for k in each], *[(upto[k] - F.expr(e).cast("long")).alias(k) for k, e in each.items()])
    return materialize(out.drop("rank_to"), f"{name}-sums")


def ends_digests(ends: DataFrame, piece: int) -> DataFrame:
    """depth, x1, x2, ends_sha256 of the nodes at which conversations end; ``ends``: these three and conv."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("first", pa.int64()), ("text", pa.string())])
        key, held, made = None, [], []

        def flush():
            if held:
                made.append((*key, held[0], ",".join(map(str, held))))

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for *k, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key or len(held) == piece:
                    flush()
                    key, held = k, []
                held.append(conv)
            if made:
                yield batch_of()
                made.clear()
        flush()
        if made:
            yield batch_of()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done = []
            for *k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == key:
                    running.update(b",")
                else:
                    if key is not None:
                        done.append((*key, running.hexdigest()))
                    key, running = k, hashlib.sha256()
                running.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*NODE, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, running.hexdigest())], names=[*NODE, "ends_sha256"])

    order = [*NODE, "conv"]
    written = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "depth long, x1 long, x2 long, first long, text string")
    with small_batches(ends.sparkSession):  # at most 1000 pieces
        return materialize(written.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "text").mapInArrow(digests, "depth long, x1 long, x2 long, ends_sha256 string"), "trie-ends")


def trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; preorder and subtree_end are its interval."""
    path, convs = rebuilt(conversations)
    path = materialize(paths(path), "trie-paths")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("m")).where("n > 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "n", "m", zero.alias("size"), zero.alias("upto"), F.lit("").alias("digest"))
    inner = path.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("conv").alias("m"), F.min("size").alias("size"), F.min("upto").alias("upto"), F.min("digest").alias("digest"))
    nodes = materialize(inner.unionByName(root), "trie-nodes")

    first = F.min_by(F.struct("x1", "x2", "digest", (F.col("upto") - F.col("size")).alias("above")), "depth")
    chains = materialize(nodes.groupBy("m", "n").agg(F.min("depth").alias("head"), F.max("depth").alias("last"), F.sum("size").alias("bytes"), first.alias("f")).select("m", "n", "head", "last", "bytes", "f.*"), "trie-chains")

    heads = chains.where("head > 0").select("m", "n", F.col("head").alias("depth"), "x1", "x2", F.col("digest").alias("d"))
    met = join_heavy(path.select("conv", *NODE), heads, NODE, "n", path.count())
    # of identical conversations, and of all but the first below a chain, no path is needed
    chief = chains.select(F.col("m").alias("_m")).distinct()
    met = met.join(chief, F.col("conv") == F.col("_m"), "left_semi")
    down = Window.partitionBy("conv").orderBy("depth")
    upto, onward = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(0, Window.unboundedFollowing)
    passed = materialize(met.select("conv", "m", "n", F.lag("m").over(down).alias("pm"), F.lag("n").over(down).alias("pn"), F.array_join(F.collect_list("d").over(upto), "").alias("place"), F.sum(F.expr("CAST(m = conv AS LONG)")).over(onward).alias("own")), "trie-passed")
    subtree = passed.groupBy(F.col("m").alias("_m"), F.col("n").alias("_n")).agg(F.sum("own").alias("chains"))
    placed = chains.join(passed.where("m = conv").select(F.col("m").alias("_pm"), F.col("n").alias("_pn"), "pm", "pn", "place"), (F.col("m") == F.col("_pm")) & (F.col("n") == F.col("_pn")), "left").join(subtree, (F.col("m") == F.col("_m")) & (F.col("n") == F.col("_n")), "left")
    total = chains.count()
    top = nodes.where("depth = 0").select(F.col("m").alias("top_m"), F.col("n").alias("top_n"))  # one row
    placed = placed.join(F.broadcast(top), F.lit(True), "left")
    is_root = F.col("head") == 0
    placed = placed.select("m", "n", "head", "last", "bytes", "above", F.coalesce("place", F.lit("")).alias("place"), F.when(~is_root, F.coalesce("pm", "top_m")).alias("pm"), F.when(~is_root, F.coalesce("pn", "top_n")).alias("pn"), F.when(is_root, F.lit(total).cast("long")).otherwise(F.col("chains")).alias("chains"))
    # a chain without chains below it ends in a leaf
    ranked = ordered_sums(placed, "place", {"leaves": "CASE WHEN chains = 1 THEN 1 ELSE 0 END", "saved": "(n - 1) * bytes", "preorder": "last - head + 1"}, "trie-ranked")
    ends_at = ranked.select(F.col("rank").alias("_r"), F.col("leaves_to").alias("l_end"), F.col("saved_to").alias("s_end"), F.col("preorder_to").alias("subtree_end"))
    children = ranked.where("pm IS NOT NULL").groupBy(F.col("pm").alias("_m"), F.col("pn").alias("_n")).agg(F.count("*").alias("kids"))
    full = ranked.join(ends_at, F.col("rank") + F.col("chains") - 1 == F.col("_r")).join(children, (F.col("m") == F.col("_m")) & (F.col("n") == F.col("_n")), "left")
    full = materialize(full.select("m", "n", "head", "last", "above", "pm", F.coalesce("kids", zero).alias("kids"), (F.col("l_end") - F.col("leaves")).alias("n_leaves"), (F.col("s_end") - F.col("saved")).alias("all_saved"), "preorder", "subtree_end", (F.col("last") - F.col("head") + 1).alias("weight")), "trie-intervals")

    turnless = convs.where("n_turns = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv")
    ends = path.select(*NODE, "conv").join(convs.withColumnRenamed("conv", "_c"), (F.col("conv") == F.col("_c")) & (F.col("depth") == F.col("n_turns"))).select(*NODE, "conv").unionByName(turnless)
    told = join_heavy(nodes, full, ["m", "n"], "weight", nodes.count()).join(ends_digests(ends, PIECE), NODE, "left")
    at_head, at_last = F.col("depth") == F.col("head"), F.col("depth") == F.col("last")
    return told.select(
        F.col("m").alias("conv_id"),
        "depth",
        F.when(at_head, F.col("pm")).otherwise(F.col("m")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(at_last, F.col("kids")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        "n_leaves",
        (F.col("all_saved") - (F.col("n") - 1) * (F.col("upto") - F.col("size") - F.col("above"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        (F.col("preorder") + F.col("depth") - F.col("head")).alias("preorder"),
        "subtree_end",
    )
