"""N-gram Jaccard join with token-combination prefixes, and the classes of linked documents.

A document's tokens are its distinct word shingles (64-bit hashes); sets link when
100 * |intersection| >= percent * |union|. Equal sets collapse into one node first, so
copies cost nothing more. For a node of n tokens let

    e = n - ceil(percent * n / 100)          tokens that a linked set may lack of it
    D = floor((100 - percent) * n / percent)   tokens in which linked sets differ at most

Tokens have a class: 1 is rare, 2 frequent, 3 very frequent. It is counted over the
region of lowest hashes of all nodes, where prefixes mostly lie. Nodes that find too few
rare tokens there are indexed from their whole sets; where that puts more than HOT of
them under one token alone, the tokens that over VERY of these nodes hold become very
frequent too and indexing begins again, until no token alone is held by so many. The
order (class, hash) is the same for all sets. A node indexes, in that order,

* its first e + 1 rare tokens, each alone, if it has so many (it shares one of them
  with any linked set that doesn't end before);
* else all its rare tokens alone, and combinations of neighbours in its frequent tokens -
  pairs in class 2, triples in class 3 - over a prefix extended until
  r + (f2 - 1) / 2 + (f3 - 2) / 3 > D. A differing token breaks at most k combinations
  of k neighbours, so D of them can't break them all. A set of few tokens may end before
  that sum is reached; where that can be (``short``), it and all sets that may link to one
  so short also index their first e + 1 tokens in order of hash, each alone: of linked
  sets' such tokens one is common to both, whatever the classes.

Take linked x and y, x's prefix ending first: what x's prefix shares with y lies in
y's prefix too, hence they share an indexed combination. If that is one of frequent
tokens and no rare token is common to both, their r and r' rare tokens are all among
those in which they differ: r + r' <= D of either (``_few``). So a node with 2 r > D
meets, under combinations, only nodes with 2 r <= D, and pages that share a frequent
template but hold many words of their own are never compared because of the template.
Sets of fewer than 100 / (100 - percent) - 1 tokens link to equal sets only and index
nothing.

Candidates pass two exact filters, by size and by parity bitmap (a bit for each hash
class of tokens, set where the set holds an odd number: sets differ in at least as many
tokens as their bitmaps in bits), then are verified by exact intersection. Where a combination has many nodes, they
are first compared with one of them (a star; its centre has the fewest rare tokens, so in
a group of near copies it is the text they come from, in the next turn it is any other);
whatever that links is one class and needs no more comparison. Only nodes of different
classes under one combination are then compared in pairs. So groups of near copies cost
in proportion to their members, and no link between classes is lost. Nodes of a large
combination are dealt into chunks, of which every two meet in a place of their own. The
links themselves (``pairs``, ``links``) take every candidate pair, also inside a class:
their number grows with the square of a group of differing near copies, as the links do.

Null and empty texts have the empty set, link with nothing and are their own class; a
repeated row is another document with an equal set. A null doc_id ranks after all others.
An empty table gives no rows. A very long text is hashed in pieces and is one set. Columns
other than doc_id and text may have any name: only ``distinct_documents`` carries them.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, keep_batches_small, materialize, mix64, shingle_hashes, word_hashes

#: A rare token lies in the regions of at most RARE nodes, a frequent one in those of VERY at most.
RARE, VERY = 6, 256
#: Nodes that may be under one token alone.
HOT = 1 << 12
#: Turns of stars at most, before what is left is compared in pairs.
STARS = 2
#: Nodes of one combination that meet in one place.
CHUNK = 1 << 12
FITS = 1 << 19  # rows of four longs that may be broadcast: 16 MB


def bounds(n: int, percent: int) -> tuple[int, int]:
    """e and D of the module's text."""
    return n + (-percent * n) // 100, (100 - percent) * n // percent


@functools.cache
def short(n: int, percent: int) -> bool:
    """Whether a set of n tokens, or one that it may link to, can have too few combinations for D."""

    def fails(m: int) -> bool:
        least = min(2 * max(0, m - 2), 3 * (m - 1), *(3 * (f2 - 1) + 2 * max(0, m - f2 - 2) for f2 in range(1, m)), 6 * m)
        return least <= 6 * bounds(m, percent)[1]

    return any(fails(m) for m in range(max(2, -(-percent * n // 100)), 100 * n // percent + 1))


def token_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), n))


def set_hash(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    with np.errstate(over="ignore"):
        a, b = mix64(tokens), mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        return int(np.sum(a, dtype=np.uint64).astype(np.int64)), int((np.sum(b, dtype=np.uint64) ^ np.uint64(len(tokens))).astype(np.int64))


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bitmap of the parities of token counts by low hash bits: about two bits a token, in 64-bit words, a power of two of them."""
    words = 1 << max(0, (2 * len(tokens) - 1 >> 6).bit_length())
    odd = np.bincount((tokens & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def region(n: int, percent: int) -> int:
    """Lowest hashes of n tokens among which frequent ones are looked for."""
    e, _ = bounds(n, percent)
    return min(n, e + 1 + (e + 1) // 4 + 3)


def described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, tx (hash of the text), n (size of the set), s1, s2 (its hash), low (its lowest tokens), bits (its parity bitmap)."""
    schema = pa.schema([("doc_id", pa.int64()), ("tx", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("low", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
    least = 100 // (100 - percent) - 1

    def run(batches):
        give_back()
        for batch in batches:
            cols = [[], [], [], [], []]
            for text in batch.column(2):
                tokens = token_set(text.as_py(), width)
                s1, s2 = set_hash(tokens)
                low = tokens[: region(len(tokens), percent)] if len(tokens) >= least else tokens[:0]
                for c, x in zip(cols, (len(tokens), s1, s2, low.view(np.int64), parity(tokens) if len(tokens) >= least else tokens[:0].view(np.int64)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:], strict=True))], schema=schema)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tx"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, tx long, n long, s1 long, s2 long, low array<long>, bits array<long>")


def small(df: DataFrame, rows: int) -> DataFrame:
    """With a broadcast hint if it has been counted to fit, else as it is: Spark then shuffles."""
    return F.broadcast(df) if rows <= FITS else df


class Join:
    """The join's parts, each written to the shared folder before it is used twice."""

    def __init__(self, docs: DataFrame, width: int = 3, percent: int = 90):
        self.docs, self.width, self.percent = docs, width, percent
        self.spark = docs.sparkSession
        keep_batches_small(self.spark)
        full = materialize(described(docs, width, percent), "jaccard-docs")
        one = F.struct("doc_id", "tx")
        first = full.where("n > 0").groupBy("s1", "s2").agg(F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), one)), F.min(one)).alias("one"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("bits").alias("bits"))
        self.nodes = materialize(first.select(F.monotonically_increasing_id().alias("node"), "one.*", *[c for c in first.columns if c != "one"]), "jaccard-nodes")
        self.all = materialize(full.select("doc_id", "tx", "n", "s1", "s2"), "jaccard-slim")
        discard(full)
        self.multi = self._shared(self._indexed())

    @functools.cached_property
    def classes(self) -> DataFrame:
        return self._classes()

    # ------------------------------------------------------------ prefixes

    def _indexed(self) -> DataFrame:
        """sig, node, n, tied, r, q: every combination that a node indexes.

        tied: it is of several tokens; r: then the node's number of rare tokens, else 0;
        q: that number for all rows of nodes whose whole set was seen, else n.
        """
        e = F.expr(f"n - (({self.percent} * n + 99) div 100)")
        lows = self.nodes.where(F.size("low") > 0).select("node", "n", "low")
        flat = lows.select("node", F.explode("low").alias("token"))
        often = materialize(flat.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > RARE).select("token", F.when(F.col("n") > VERY, 3).otherwise(2).alias("class")), "jaccard-frequent")
        wide, some = None, 0
        while True:
            n_often = often.count()
            hit = flat.join(small(often.select("token"), n_often), "token").groupBy("node").agg(F.collect_list("token").alias("often"))  # within one node's region
            rare = lows.join(hit, "node", "left").withColumn("rare", F.when(F.col("often").isNull(), F.col("low")).otherwise(F.array_except("low", "often")))
            prefix = materialize(rare.select("node", "n", F.when(F.size("rare") > e, F.slice("rare", F.lit(1), (e + 1).cast("int"))).alias("prefix")), "jaccard-prefix")
            more = prefix.where("prefix is null").select("node")
            more = more if wide is None else more.join(small(wide.select("node"), some), "node", "left_anti")
            if not more.isEmpty():
                new = self._sets(more)
                wide = new if wide is None else wide.unionByName(new)
                some = wide.count()
            plain = prefix.where("prefix is not null").select(F.explode("prefix").alias("sig"), "node", "n", F.lit(False).alias("tied"), F.lit(0).cast("long").alias("r"), F.col("n").alias("q"))
            index = materialize(plain if wide is None else plain.unionByName(self._combined(wide, often, n_often)), "jaccard-index")
            discard(prefix)
            if wide is None:
                return index
            held = index.where("not tied").groupBy("sig").agg(F.count("*").alias("m")).where(F.col("m") > HOT).select(F.col("sig").alias("token"))
            hot = held.join(small(often, n_often), "token", "left_anti")  # sets of few tokens index frequent ones alone too
            n_hot = hot.count()
            if not n_hot:
                return index
            hot = materialize(hot, "jaccard-hot")
            under = index.where("not tied").join(small(hot.select(F.col("token").alias("sig")), n_hot), "sig").select("node").distinct()
            full = wide.join(under, "node").select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > VERY).select("token")
            fresh = full.unionByName(hot).distinct().join(small(often, n_often), "token", "left_anti")
            often = materialize(often.unionByName(fresh.select("token", F.lit(3).alias("class"))), "jaccard-frequent")
            discard(index)

    def _combined(self, full: DataFrame, often: DataFrame, n_often: int) -> DataFrame:
        """What nodes index whose whole sets are at hand (node, n, tokens)."""
        p = self.percent
        flat = full.select("node", F.explode("tokens").alias("token")).join(small(often, n_often), "token")
        known = flat.groupBy("node").agg(F.collect_list(F.struct("token", "class")).alias("often"))  # one node's tokens
        rows = full.join(known, "node", "left").select("node", "n", "tokens", "often")

        def run(batches):
            give_back()
            for batch in batches:
                cols = [[], [], [], [], [], []]
                for node, n, tokens, often in zip(*(batch.column(i) for i in range(4)), strict=True):
                    node, n, tokens = node.as_py(), n.as_py(), tokens.values.to_numpy()
                    alone, tied, r, q = combinations(tokens.view(np.uint64), {x["token"]: x["class"] for x in often.as_py() or []}, p)
                    k = len(alone) + len(tied)
                    for c, x in zip(cols, (np.concatenate([alone, tied]), np.full(k, node), np.full(k, n), np.arange(k) >= len(alone), np.repeat([0, r], [len(alone), len(tied)]), np.full(k, q)), strict=True):
                        c.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["sig", "node", "n", "tied", "r", "q"])

        return rows.mapInArrow(run, "sig long, node long, n long, tied boolean, r long, q long")

    def _shared(self, sigs: DataFrame) -> DataFrame:
        """Combinations of two nodes or more; each node is its own class yet."""
        held = sigs.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1").select("sig")
        shared = materialize(sigs.drop("tied").join(held, "sig").withColumn("root", F.col("node")), "jaccard-shared")
        discard(sigs)
        return shared

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """node, n, tokens (sorted by unsigned value) of some nodes, from their texts."""
        nodes = materialize(nodes.join(self.nodes, "node").select("node", "doc_id", "tx", "s1", "s2", "copies"), "jaccard-some")
        some, width = nodes.count(), self.width
        text = F.col("text").cast("string")
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tx"), text.alias("text"))
        # by text as well: null and repeated ids are no key
        found = texts.join(small(nodes, some), texts.doc_id.eqNullSafe(nodes.doc_id) & (texts.tx == nodes.tx)).select("node", "s1", "s2", "text", "copies")
        again = found.where("copies > 1").dropDuplicates(["node", "text"])  # only these can be rows alike in id and text
        found = found.where("copies = 1").unionByName(again).drop("copies")

        def run(batches):
            give_back()
            for batch in batches:
                out = ([], [], [])
                for node, s1, s2, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                    tokens = token_set(text.as_py(), width)
                    if set_hash(tokens) == (s1.as_py(), s2.as_py()):
                        for c, x in zip(out, (node.as_py(), len(tokens), tokens.view(np.int64)), strict=True):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], names=["node", "n", "tokens"])

        return materialize(found.mapInArrow(run, "node long, n long, tokens array<long>"), "jaccard-sets")

    # ------------------------------------------------------------ links

    def _near(self, a, b) -> Column:
        """Sizes that can link."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def _most(self, n) -> Column:
        """D of the module's text."""
        return F.floor((100 - self.percent) * F.col(n) / self.percent)

    def _few(self, n: str, r: str, m: str, q: str) -> Column:
        """Numbers of rare tokens that can link where none is common: r of n tokens, q of m."""
        return F.col(r) + F.col(q) <= F.least(self._most(n), self._most(m))

    def _met(self, rows: DataFrame, more: tuple[str, ...] = (), also: Column | None = None) -> DataFrame:
        """Pairs of rows (sig, node, n, r and ``more``) under one combination, as x_ and y_ columns, that sizes, rare tokens and ``also`` allow.

        x is light, with 2 r <= D; y is light too, then the two meet once, or heavy. The
        light rows of a large combination are dealt into chunks by node, and so are all
        its rows; each two chunks meet under a key of their own, so no task has one
        combination's square.
        """
        rows = rows.withColumn("light", 2 * F.col("r") <= self._most("n"))
        parts = [F.greatest(F.lit(1), F.ceil(F.col(c) / CHUNK)).cast("int").alias(k) for c, k in (("m", "k"), ("x", "kx"))]
        many = rows.groupBy("sig").agg(F.count("*").alias("m"), F.count_if("light").alias("x")).where(F.col("m") > CHUNK).select("sig", *parts)
        held, n = rows.withColumns({"k": F.lit(1), "kx": F.lit(1)}), many.count()
        if n:
            held = rows.join(small(materialize(many, "jaccard-many"), n), "sig", "left").withColumns({"k": F.coalesce("k", F.lit(1)), "kx": F.coalesce("kx", F.lit(1))})
        held = held.withColumn("h", F.xxhash64("node"))
        name = lambda c: [F.col(k).alias(f"{c}_{k}") for k in ("sig", "node", "n", "r", "light", *more)]
        x = held.where("light").select(F.pmod("h", F.col("kx")).cast("int").alias("x_x"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("x_y"), *name("x"))
        y = held.select(F.explode(F.sequence(F.lit(0), F.col("kx") - 1)).alias("y_x"), F.pmod("h", F.col("k")).cast("int").alias("y_y"), *name("y"))
        here = (F.col("x_sig") == F.col("y_sig")) & (F.col("x_x") == F.col("y_x")) & (F.col("x_y") == F.col("y_y"))
        meet = here & (~F.col("y_light") | (F.col("x_node") < F.col("y_node"))) & self._near("x_n", "y_n") & self._few("x_n", "x_r", "y_n", "y_r")
        return x.join(y, meet if also is None else meet & also)

    def _alike(self, x: str, y: str, n: str, m: str) -> Column:
        """Bitmaps that can link: they differ in no more bits than linked sets of n and m tokens in tokens."""
        # bits of a longer bitmap that fall together in a shorter one are added, so lengths can differ
        fold = lambda long, short: F.expr(f"transform({short}, (w, i) -> aggregate(sequence(i, size({long}) - 1, size({short})), w, (s, j) -> s ^ {long}[j]))")
        bits = F.when(F.size(x) >= F.size(y), fold(x, y)).otherwise(fold(y, x))
        return F.aggregate(bits, F.lit(0), lambda s, w: s + F.bit_count(w)) * (100 + self.percent) <= (F.col(n) + F.col(m)) * (100 - self.percent)

    def _passing(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose bitmaps can link."""
        side = lambda c, k: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
        return pairs.join(side("a", 1), "a").join(side("b", 2), "b").where(self._alike("bits1", "bits2", "n1", "n2")).select("a", "b")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose sets link."""
        s = self._sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = pairs.join(s.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(s.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
        same = F.size(F.array_intersect("ta", "tb"))
        return both.where(same * 100 >= (F.size("ta") + F.size("tb") - same) * self.percent).select("a", "b")

    def _linked(self, pairs: DataFrame) -> DataFrame:
        return materialize(self._verified(materialize(self._passing(pairs.distinct()), "jaccard-pairs")), "jaccard-links")

    def _classes(self) -> DataFrame:
        """node, root: of all nodes that have a link."""
        both = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
        left, links, roots, turn = self.multi, None, None, 0
        while True:
            # stars: every node under a combination against one of them
            first = [F.col("q"), -F.col("n")] if turn == 0 else [2 * F.col("r") > self._most("n"), F.lit(0)]
            centre = left.groupBy("sig").agg(F.min(F.struct(first[0].alias("f"), first[1].alias("g"), F.xxhash64(F.lit(turn), "sig", "node").alias("h"), "node", "n", "r", "root")).alias("c"))
            star = left.join(centre, "sig").where((F.col("root") != F.col("c.root")) & self._near("n", "c.n") & self._few("n", "r", "c.n", "c.r")).select(*both("node", "c.node"))
            found = self._linked(star)
            grown = bool(found.head(1))
            if grown or roots is None:
                links = found if links is None else links.unionByName(found)
                roots = components(links)
            # combinations that still join different classes
            named = self.multi.select("sig", "node", "n", "r", "q").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            split = named.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("sig")
            left, turn = named.join(split, "sig"), turn + 1
            left = materialize(left, "jaccard-left")
            if not grown or turn == STARS:
                break
        brief = F.expr("if(size(bits) > 8, transform(slice(bits, 1, 8), (w, i) -> aggregate(sequence(i + 8, size(bits) - 1, 8), w, (s, j) -> s ^ bits[j])), bits)")
        left = materialize(left.join(self.nodes.select("node", brief.alias("bits")), "node"), "jaccard-brief")
        met = self._met(left, ("root", "bits"), (F.col("x_root") != F.col("y_root")) & self._alike("x_bits", "y_bits", "x_n", "y_n"))
        found = self._linked(met.select(*both("x_node", "y_node")))
        return components(links.unionByName(found)) if found.head(1) else roots

    def pairs(self) -> DataFrame:
        """a, b: all pairs of nodes that link, those of one class too."""
        return self._linked(self._met(self.multi).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")))

    def links(self) -> DataFrame:
        """doc_id, links: the number of other documents that each document links with."""
        pairs = self.pairs()
        sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = sides.join(self.nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("near"))
        of = self.nodes.select(F.col("node").alias("a"), "s1", "s2", "copies").join(near, "a", "left").select("s1", "s2", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))
        full = self.all.where("n > 0").join(of, ["s1", "s2"]).select("doc_id", "links")
        return full.unionByName(self.all.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("links")))

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id (smallest doc_id of its class), copies (documents with an equal set), tx, stays (its text is that of the class's first document)."""
        names = self.nodes.select("node", "s1", "s2", "doc_id", "copies").join(self.classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = names.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("f"))
        of = names.join(least, "root").select("s1", "s2", F.col("f.doc_id").alias("component_id"), (F.col("f.node") == F.col("node")).alias("here"), "copies")
        rows = self.all.select("doc_id", "tx", "n", "s1", "s2")
        stays = (F.col("here") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")
        full = rows.where("n > 0").join(of, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "copies", "tx", stays)
        none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("copies"), "tx", F.lit(True).alias("stays"))
        return full.unionByName(none)


def combinations(tokens: np.ndarray, classes: dict[int, int], percent: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of a node's tokens (sorted by hash): those indexed alone, hashes of those combined, the number of rare ones where there are combined ones, and in any case."""
    kind = np.array([classes.get(t, 1) for t in tokens.view(np.int64).tolist()], np.int64)
    e, d = bounds(len(tokens), percent)
    one, two, three = (tokens[kind == k] for k in (1, 2, 3))
    if len(one) > e:
        return one[: e + 1].view(np.int64), np.empty(0, np.int64), 0, len(one)
    r = len(one)
    # 6 r + 3 (f2 - 1) + 2 (f3 - 2) > 6 D, class 2 first
    f2 = min(len(two), max(0, (6 * d - 6 * r) // 3 + 2))
    missing = 6 * d - 6 * r - 3 * max(0, f2 - 1)
    f3 = min(len(three), missing // 2 + 3) if missing >= 0 else 0
    alone = np.unique(np.concatenate([one, tokens[: e + 1]])) if short(len(tokens), percent) else one
    tied = [np.empty(0, np.uint64)]
    with np.errstate(over="ignore"):
        for k, own in ((2, two[:f2]), (3, three[:f3])):
            if len(own) >= k:
                h = np.full(len(own) - k + 1, np.uint64(k * 0x9E3779B9), np.uint64)
                for j in range(k):
                    h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + own[j : len(own) - k + 1 + j])
                tied.append(h)
    return alone.view(np.int64), np.unique(np.concatenate(tied)).view(np.int64), r, r


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of the nodes in links, by alternating large and small stars."""
    edges = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), F.col("b").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small_ = large.join(low, "b").select(F.col("m").alias("x"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("y"))
        new = materialize(small_.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "small-star")
        sums = [d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for d in (edges, new)]
        edges = new
        if sums[0] == sums[1]:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each class the smallest doc_id stays; rows alike in id and text, once."""
    columns = docs.columns
    key = lambda c: [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias("k"), F.col(c).isNull().alias("z")]
    stay = Join(docs, width, percent).result().where("stays").select(*key("doc_id"), "tx")
    rows = docs.select(*key("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tx"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    out = rows.join(stay, ["k", "z", "tx"], "left_semi").dropDuplicates(["k", "z", "tx"])  # one shuffle serves both
    return out.select(*[F.col(f"row.`{c}`") for c in columns])
