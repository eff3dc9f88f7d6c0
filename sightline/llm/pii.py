"""Personal data: fixed detectors, and bootstrapped contextual extraction around them.

Detectors (``base``) find e-mail addresses, IP addresses, payment cards and phone
numbers. They seed the bootstrap, with one more kind of seed entity that is not reported
by itself: digests of 32, 40 or 64 hexadecimal digits (``DIGEST``), the form of keys and
tokens. A word that holds an instance stands in four lexical patterns: the two words
before it, the word before it, the word behind it, and the words on both sides, each with
the quote or bracket on the instance's own edge. Patterns and instances (words with a
digit, cleaned of marks) form a bipartite graph, its edges weighted by places.

A pattern with ``support`` different known instances has a confidence: the share of all
its places, ordinary words included, that known instances hold. At ``trust`` it is
trusted. An instance that looks like an identifier (``SHAPE``) scores 1 - product of
(1 - confidence) over its trusted patterns; at ``accept`` it becomes known, and counts
for all patterns it stands in - also those that no seed was seen in - in the next round.
Rounds go on until no instance is new. Words in a trusted pattern that are known and
that no detector found are spans of kind ``id``.

Before the graph is built, patterns leave that could not be trusted if every instance in
them were known: that drops nothing. All is DataFrame expressions. Offsets are code
points. A null or empty text has no spans, an empty table no rows; columns other than
doc_id and text play no part. Repeated rows have equal spans. Sums are partial where
rows are read, so a pattern of a third of all places goes through no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The contract's expressions. Possessive quantifiers and the boundaries before the first
#: character leave their matches as they are, and make scans linear and free of recursion:
#: a match can only begin within a run of its first class where another has just ended.
DETECTORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a detector to be worth running.
HINTS = {"email": "%@%", "ip": "%.%", "card": None, "phone": "%+%"}
WORD = r"[^\x20\x09-\x0D]+"
SHAPE = r"^(?=.*[0-9])[A-Za-z0-9][A-Za-z0-9._#/:-]{3,62}[A-Za-z0-9]$"
DIGEST = r"^(?=.*[a-f])(?=.*[0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
OPENING, CLOSING = "\"'([<{", "\"')]>},.;:!?"
#: Words of one find (phones, cards) are held together by this in place of their blanks.
GLUE = "\u00a0"
FITS = 1 << 19


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda s, v: s + v)


def running(lens: Column) -> Column:
    """Sums of all elements before each, in blocks of 64: far from quadratic for any length."""

    def within(n: Column, sums: Column) -> Column:
        last = F.floor(F.size(n) / 64).cast("int")
        block = lambda b: _let(_sum(F.slice(sums, F.lit(1), b)), lambda base: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(64), F.size(n) - b * 64))), lambda i: base + _sum(F.slice(n, b * 64 + 1, i - 1))))
        return F.flatten(F.transform(F.sequence(F.lit(0), last), block))

    def blocks(n: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 64).cast("int")), lambda b: _sum(F.slice(n, b * 64 + 1, F.lit(64))))
        return _let(sums, lambda s: within(n, s))

    return _let(lens, blocks)


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":

        def luhn(d: Column) -> Column:
            value = lambda i: F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
            twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(value(i))).otherwise(value(i))) % 10 == 0

        return F.length(digits).between(13, 19) & _let(digits, luhn)
    return F.lit(True)


def found(kind: str, text: Column) -> Column:
    """Array of (kind, a, b, value) of a detector's valid finds."""
    pattern = DETECTORS[kind]
    none = F.array().cast("array<struct<kind:string,a:int,b:int,value:string>>")

    def spans(both: Column) -> Column:
        gaps, finds = both["g"], both["m"]
        lens = F.transform(finds, lambda m, i: F.length(m) + F.length(gaps[i]))
        all_ = _let(running(lens), lambda at: F.transform(finds, lambda m, i: F.struct(F.lit(kind).alias("kind"), (at[i] + F.length(gaps[i])).alias("a"), (at[i] + F.length(gaps[i]) + F.length(m)).alias("b"), m.alias("value"))))
        return F.filter(all_, lambda s: _valid(kind, s["value"]))

    some = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, _let(F.struct(F.split(text, pattern, -1).alias("g"), m.alias("m")), spans)).otherwise(none))
    hint = HINTS[kind]
    return F.when(text.like(hint), some).otherwise(none) if hint else some


def base(docs: DataFrame) -> DataFrame:
    """doc_id, tx (hash of the text), finds: what the detectors see, by kind, then place."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tx"), text.alias("text"))
    return rows.select("doc_id", "tx", F.concat(*[found(kind, F.col("text")) for kind in DETECTORS]).alias("finds"))


def _edge(word: Column, side: str) -> Column:
    """The quote, bracket or stop on a word's edge, else nothing."""
    one = F.substring(word, 1, 1) if side == "open" else F.right(word, F.lit(1))
    return F.when(one.isin(*(OPENING if side == "open" else CLOSING)), one).otherwise("")


def words_of(docs: DataFrame) -> DataFrame:
    """doc_id, tx, i, w, p1, p2, n1: every word of every text with its number, the two before it and the one behind it ('' beyond the ends)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    glued = F.when(text.rlike(r"[0-9)]\x20[0-9(]"), F.regexp_replace(text, r"(?<=[0-9)])\x20(?=[0-9(])", GLUE)).otherwise(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tx"), F.regexp_extract_all(glued, F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    none = F.array(F.lit(""))
    zipped = F.arrays_zip(F.col("w"), F.concat(none, "w").alias("p1"), F.concat(none, none, "w").alias("p2"), F.concat(F.slice("w", F.lit(2), F.size("w")), none).alias("n1"))
    return rows.select("doc_id", "tx", F.posexplode(zipped).alias("i", "z")).select("doc_id", "tx", "i", F.col("z.w").alias("w"), F.col("z.p1").alias("p1"), F.col("z.p2").alias("p2"), F.col("z.n1").alias("n1")).where(F.col("w").isNotNull())


def patterns_of() -> Column:
    """Hashes of the patterns around a word of ``words_of``."""
    p1, p2, n1 = F.lower("p1"), F.lower("p2"), F.lower("n1")
    opened, closed = _edge(F.col("w"), "open"), _edge(F.col("w"), "close")
    return F.array(F.xxhash64(F.lit("left two"), p2, p1, opened), F.xxhash64(F.lit("left"), p1, opened), F.xxhash64(F.lit("right"), closed, n1), F.xxhash64(F.lit("both"), p1, opened, closed, n1))


def mentions_of(docs: DataFrame) -> DataFrame:
    """doc_id, tx, i, lead, len, instance, shaped, hs: words that could be instances; their cleaned part begins after ``lead`` letters and has ``len``."""
    lead = F.length("w") - F.length(F.ltrim(F.col("w"), F.lit(OPENING)))
    clean = F.rtrim(F.ltrim(F.col("w"), F.lit(OPENING)), F.lit(CLOSING))
    rows = words_of(docs).where(F.col("w").rlike("[0-9@]"))
    return rows.select("doc_id", "tx", "i", lead.alias("lead"), F.length(clean).alias("len"), F.lower(clean).alias("instance"), clean.rlike(SHAPE).alias("shaped"), patterns_of().alias("hs")).where(F.col("len") >= 5)


def fitting(df: DataFrame) -> DataFrame:
    """With a broadcast hint if it has been counted to fit."""
    return F.broadcast(df) if df.count() <= FITS else df


def bootstrap(docs: DataFrame, finds: DataFrame, support: int = 3, trust: float = 0.8, accept: float = 0.8) -> DataFrame | None:
    """doc_id, tx, extra (array of kind, a, b): identifiers that trusted patterns reach; None where there are none.

    Support is of different values, so copies of one text make no pattern; how large the
    corpus is makes no difference.
    """
    mentions = materialize(mentions_of(docs), "pii-mentions")
    seeds = finds.select(F.explode("finds").alias("f")).select(F.replace(F.lower("f.value"), F.lit(" "), F.lit(GLUE)).alias("instance")).distinct()
    edges = mentions.select(F.explode("hs").alias("h"), "instance", "shaped").groupBy("h", "instance").agg(F.count("*").alias("n"), F.max("shaped").alias("shaped"))
    edges = materialize(edges, "pii-edges")
    some = materialize(edges.groupBy("h").agg(F.count("*").alias("values"), F.sum("n").alias("m")).where(F.col("values") >= support).select("h", "m"), "pii-patterns")
    n = some.count()
    if not n:
        return None
    every = words_of(docs).select(F.explode(patterns_of()).alias("h"))
    if n <= FITS:
        total = every.join(F.broadcast(some), "h").groupBy("h").agg(F.count("*").alias("total"), F.first("m").alias("m"))
    else:
        total = every.groupBy("h").agg(F.count("*").alias("total")).join(some, "h")
    able = materialize(total.where(F.col("m") >= trust * F.col("total")).select("h", "total"), "pii-able")
    own = edges.join(fitting(able), "h")
    known = own.join(seeds.withColumn("seed", F.lit(True)), "instance", "left")
    first = F.when(F.col("seed") | F.col("instance").rlike(DIGEST), 1.0).otherwise(0.0)
    graph, sure = materialize(known.select("h", "instance", "n", "total", "shaped", first.alias("score")), "pii-graph"), -1
    while True:
        trusted = graph.groupBy("h").agg((F.sum(F.col("n") * F.col("score")) / F.first("total")).alias("conf"), F.count_if(F.col("score") > 0).alias("known"))
        trusted = trusted.where((F.col("known") >= support) & (F.col("conf") >= trust)).select("h", "conf")
        now = graph.where("score > 0").select("instance").distinct().count()
        if now == sure:
            break
        sure = now
        told = graph.join(trusted, "h").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1.0000001 - F.col("conf"))))).alias("new")).where(F.col("new") >= accept)
        score = F.when(F.col("score") > 0, F.col("score")).when(F.col("shaped") & F.col("new").isNotNull(), F.col("new")).otherwise(0.0)
        graph = materialize(graph.join(told, "instance", "left").select("h", "instance", "n", "total", "shaped", score.alias("score")), f"pii-round-{sure}")
    reached = materialize(graph.where("score > 0").join(trusted, "h").select("h", "instance").distinct(), "pii-reached")
    if reached.isEmpty():
        return None
    at = mentions.select("doc_id", "tx", "i", "lead", "len", "instance", F.explode("hs").alias("h")).join(fitting(reached), ["h", "instance"]).select("doc_id", "tx", "i", "lead", "len").distinct()
    marks = fitting(materialize(at.groupBy("doc_id", "tx").agg(F.collect_list(F.struct("i", "lead", "len")).alias("hits")), "pii-marks"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tx"), text.alias("text"))
    both = rows.join(marks, rows.doc_id.eqNullSafe(marks.doc_id) & (rows.tx == marks.tx)).select(rows.doc_id, rows.tx, "text", "hits").dropDuplicates(["doc_id", "tx"])
    glued = F.regexp_replace("text", r"(?<=[0-9)])\x20(?=[0-9(])", GLUE)
    parts = F.struct(F.split(glued, WORD, -1).alias("g"), F.regexp_extract_all(glued, F.lit(WORD), F.lit(0)).alias("w"))
    starts = _let(parts, lambda t: F.struct(running(F.transform(t["w"], lambda w, i: F.length(w) + F.length(t["g"][i]))).alias("at"), t["g"].alias("g")))
    begin = lambda t, s: t["at"][s["i"]] + F.length(t["g"][s["i"]]) + s["lead"]
    extra = _let(starts, lambda t: F.transform("hits", lambda s: F.struct(F.lit("id").alias("kind"), begin(t, s).alias("a"), (begin(t, s) + s["len"]).alias("b"))))
    return both.select("doc_id", "tx", extra.alias("extra"))


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans (kind:start:end) and their number of every document. Kind ``id``: found by context alone."""
    docs = docs.select("doc_id", "text")
    finds = materialize(base(docs), "pii-base")
    extra = bootstrap(docs, finds)
    spans = finds.select("doc_id", "tx", F.transform("finds", lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("a"), s["b"].alias("b"))).alias("own"))
    if extra is None:
        both = spans.withColumn("extra", F.array().cast("array<struct<kind:string,a:int,b:int>>"))
    else:
        both = spans.join(extra, spans.doc_id.eqNullSafe(extra.doc_id) & (spans.tx == extra.tx), "left").select(spans.doc_id, "own", F.coalesce("extra", F.array().cast("array<struct<kind:string,a:int,b:int>>")).alias("extra"))
        clear = lambda x: ~F.exists("own", lambda s: (s["a"] < x["b"]) & (x["a"] < s["b"]))
        both = both.withColumn("extra", F.array_sort(F.filter("extra", clear)))
    count = lambda kind: F.size(F.filter("own", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return both.select("doc_id", *map(count, DETECTORS), F.sha2(_join(F.col("own")).cast("binary"), 256).alias("base_sha256"), _join(F.concat("own", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_id"), (F.size("own") + F.size("extra")).cast("long").alias("n_spans"))
