"""Toxicity of texts that may be disguised: a noisy channel, then a linear model.

* Language model: counts of 1- to 4-grams of lower-cased letters, other characters as one
  blank, over *all* texts (labelled or not), hashed into ``GRAMS`` cells; a character's
  probability interpolates the four orders.
* Channel: a span that looks disguised is a lattice of readings for each character. A
  digit or symbol may be a letter that it resembles, a separator to drop, or the end of a
  word; a repeated letter may be one letter; blanks and marks between single letters may
  be dropped. The Viterbi path of least cost under channel and language model is read in
  the span's place. Spans are tokens with a digit or symbol at a letter or between
  letters, tokens with a letter three times in a row, or twice where the model finds that
  rare, and three or more single characters written apart. All other words stay.
* Score: presence of words and of their beginnings (3 to ``LONGEST`` letters), hashed into
  ``DIMS`` cells. Cells are kept where their documents' labels differ significantly, by
  counts over all rows that may be learned from; a logistic model over these is fitted by
  follow-the-regularised-leader on about ``per_class`` rows a class (a documented bound;
  picked by a seeded hash, alike at every size), its bias set to the classes' true shares.

Labels: a doc_id labelled more than once counts as toxic if any label says so; null labels
and values other than 0 and 1 say nothing. Rows may be learned from where crc32(doc_id as
text) mod 5 isn't 0. A score sees the text alone. Null texts are empty; an empty text, or
one without letters, scores what the bias says. With labels of one class or none nothing
is learned, and every score is 0. An empty table gives no rows; columns beside doc_id and
text play no part; repeated rows score alike; a null doc_id has a null ``held_out``. Long
texts are read in pieces, cut behind a word of two characters or more, so that no span is
cut. Scoring only maps rows; labels meet the documents in one join, on doc_id, dealt
afresh by adaptive execution where one id is frequent.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep_batches_small, materialize, small_batches
from .langid import fit_ftrl

GRAMS = 1 << 20
DIMS = 1 << 20
SHORTEST, LONGEST = 3, 8
PIECE = 1 << 20
SLICE = 1 << 16  # characters hashed together: arrays that stay near the processor
BLANK = 32
APART_TEXTS = "\n\0\n"  # between texts that are read together: no span crosses it
#: What characters may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l"}
#: Costs of the channel, in nats.
LETTER, ONCE, DROP, DROP_DIGIT, END, APART = 1.0, 1.0, 1.5, 5.0, 3.0, 0.5
_MASK = (1 << 64) - 1
_STEP, _LAST = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BEHIND_WORD = re.compile(r"\S{2,}\s")


def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 may stand for a letter, 3 white space."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = 1
        elif x.isspace():
            table[c] = 3
    table[[ord(c) for c in LOOKS]] = 2
    return table


_CLASSES: list[np.ndarray] = []


def codes_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    if not _CLASSES:
        _CLASSES.append(_classes())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, _CLASSES[0][codes]


def pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        cut = _BEHIND_WORD.search(text, at + PIECE)
        to = cut.end() if cut else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


# ---------------------------------------------------------------- language model


def step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (h + codes) * np.uint64(_STEP)


def cells_of(h: np.ndarray, kind: int) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) + np.uint64(kind)) * np.uint64(_LAST) >> np.uint64(44)).astype(np.int64)


def _grams(codes: np.ndarray, classes: np.ndarray) -> list[np.ndarray]:
    """Cells of the grams of 1 to 4 characters; blanks are one, and stand at both ends."""
    c = np.concatenate([[BLANK], np.where(classes == 1, codes, BLANK), [BLANK]]).astype(np.uint64)
    kept = np.ones(len(c), bool)
    kept[1:] = (c[1:] != BLANK) | (c[:-1] != BLANK)
    c = c[kept]
    out: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, len(c), SLICE):
        part, h = c[at : at + SLICE + 3], np.zeros(min(SLICE, len(c) - at), np.uint64)
        for order in range(4):
            h = step(h[: len(part) - order], part[order : order + len(h)])
            out[order].append(cells_of(h, order))
    return [np.concatenate(x) for x in out]


def cell(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h + ord(c)) * _STEP & _MASK
    return ((h ^ (h >> 29)) + len(gram) - 1) * _LAST % (1 << 64) >> 44


@dataclass
class Characters:
    """Counts of grams; ``cost(context, c)`` is the negative logarithm of c's probability behind up to three characters."""

    counts: np.ndarray
    total: float
    known: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.counts, self.total

    def __setstate__(self, state):
        self.counts, self.total, self.known = *state, {}

    def cost(self, context: str, c: str) -> float:
        key = context + c
        if (got := self.known.get(key)) is None:
            p = (self.counts[cell(c)] + 0.1) / (self.total + 1000)
            for k in range(1, len(context) + 1):
                before = self.counts[cell(context[-k:])]
                p = (self.counts[cell(context[-k:] + c)] + 4 * p) / (before + 4)
            if len(self.known) > 1 << 18:
                self.known.clear()
            got = self.known[key] = -math.log(max(p, 1e-12))
        return got

    def rare_twice(self, before: np.ndarray, twice: np.ndarray) -> np.ndarray:
        """Whether (before, c, c) is hardly ever seen though (before, c) is."""
        two = step(step(np.zeros(len(before), np.uint64), before.astype(np.uint64)), twice)
        return self.counts[cells_of(step(two, twice), 2)] < 0.002 * self.counts[cells_of(two, 1)]


def characters(docs: DataFrame) -> Characters:
    """The character model of all texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        total, held, size = np.zeros(GRAMS, np.int64), [], 0

        def add():
            nonlocal total
            codes, classes = codes_of(" ".join(held))
            for grams in _grams(codes, classes):
                total += np.bincount(grams, minlength=GRAMS)

        for batch in batches:
            for text in batch.column(0):
                for piece in pieces((text.as_py() or "").lower()):
                    held.append(piece)
                    size += len(piece) + 1
                    if size > PIECE:
                        add()
                        held, size = [], 0
        add()
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["f", "n"])

    found = docs.select("text").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()  # at most GRAMS rows of two numbers
    counts = np.zeros(GRAMS)
    counts[found.column("f").to_numpy()] = found.column("n").to_numpy()
    return Characters(counts.astype(np.float32), float(counts.sum() / 4))


# ---------------------------------------------------------------- channel


def readings(span: str) -> list[list[tuple[str, float]]]:
    """For each character what it may be read as, with a cost: a letter, a blank, or nothing."""
    out, apart = [], len(span) > 2 and all(c.isspace() for c in span[1::2])
    for k, c in enumerate(span):
        if c.isalpha():
            one = [(c, 0.0)]
            if k and span[k - 1] == c:
                one.append(("", ONCE))
        elif c.isspace():
            one = [("", APART), (" ", APART)] if apart else [(" ", 0.0)]
        elif c in LOOKS:
            one = [(x, LETTER) for x in LOOKS[c]] + [("", DROP_DIGIT if c.isdigit() else DROP), (" ", END)]
            if k and span[k - 1] == c:
                one.append(("", ONCE))
        else:
            one = [("", DROP), (" ", END / 2)]
        out.append(one)
    return out


def decode(span: str, lm: Characters) -> str:
    """The reading of least cost: letters and blanks. Exact over states of the last three characters."""
    states = {" ": (0.0, None)}  # context -> cost, characters as a chain
    for options in [*readings(span), [(" ", 0.0)]]:
        after: dict = {}
        for context, (cost, chain) in states.items():
            for c, price in options:
                if c == "":
                    to, whole, link = context, cost + price, chain
                elif c == " " and context[-1] == " ":
                    to, whole, link = context, cost + price, chain
                else:
                    to, whole, link = (context + c)[-3:], cost + price + lm.cost(context, c), (chain, c)
                if to not in after or whole < after[to][0]:
                    after[to] = whole, link
        states = after
    chain, out = min(states.items(), key=lambda s: (s[1][0], s[0]))[1][1], []
    while chain is not None:
        chain, c = chain
        out.append(c)
    return "".join(reversed(out)).strip()


def spans(codes: np.ndarray, classes: np.ndarray, lm: Characters) -> list[tuple[int, int]]:
    """Where the text looks disguised: (start, end), in order."""
    n = len(codes)
    if not n:
        return []
    letter, look, space = classes == 1, classes == 2, classes == 3
    pad = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, n), x.dtype)])[:n] if k > 0 else np.concatenate([np.zeros(min(-k, n), x.dtype), x[: max(0, n + k)]])
    prev, nxt = pad(letter, -1), pad(letter, 1)
    same = pad(codes, -1) == codes
    same[0] = False
    odd = ~letter & ~space & prev & nxt  # anything between letters
    strong = look & ~same & ~pad(same, 1) & (prev | nxt)
    punctuation = np.isin(codes, [ord(c) for c in "!|+"])  # at the end of a word these are what they are
    odd |= strong & (~punctuation | nxt | pad(look, 1))
    twice = letter & same
    odd |= twice & pad(twice, -1)
    at = np.flatnonzero(twice & ~pad(twice, -1))
    at = at[at > 1] if len(at) else at
    if len(at):
        before = np.where(letter[at - 2], codes[at - 2], BLANK)
        odd[at[lm.rare_twice(before, codes[at].astype(np.uint64))]] = True
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return []
    single = (end - start == 1) & (classes[start] != 0)
    turn = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
    first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = last - first >= 3
    out = [(int(start[a]), int(end[b - 1])) for a, b in zip(first[long], last[long], strict=True)]
    if odd.any():
        sums = np.concatenate([[0], np.cumsum(odd)])
        hit = np.flatnonzero((sums[end] > sums[start]) & ~single)
        out += [(int(start[k]), int(end[k])) for k in hit]
    return sorted(out)


def core(token: str) -> str:
    """A span without the decoration around it: marks, but for one that may stand for a letter."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum() and not (token[a] in LOOKS and token[a + 1 : a + 2].isalnum()):
        a += 1
    while b > a and not token[b - 1].isalnum() and not (token[b - 1] in "@$" and token[b - 2].isalnum()):
        b -= 1
    return token[a:b]


def restored_spans(text: str, codes: np.ndarray, classes: np.ndarray, lm: Characters, memo: dict) -> list[tuple[int, int, str]]:
    """(start, end, reading) of each disguised span of a lower-cased text."""
    out = []
    for a, b in spans(codes, classes, lm):
        inner = core(text[a:b])
        if (got := memo.get(inner)) is None:
            if len(memo) > 50_000:
                memo.clear()
            got = memo[inner] = decode(inner, lm) if inner else ""
        out.append((a, b, got))
    return out


def restore(text: str | None, lm: Characters, memo: dict | None = None) -> str:
    """The whole text, lower-cased, with every disguised span read."""
    out = []
    for piece in pieces((text or "").lower()):
        at = 0
        for a, b, got in restored_spans(piece, *codes_of(piece), lm, {} if memo is None else memo):
            out += [piece[at:a], got]
            at = b
        out.append(piece[at:])
    return "".join(out)


# ---------------------------------------------------------------- features and model


def word_features(codes: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the words and of their beginnings, with repeats, and where their words start."""
    edge = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = end - start
    order = np.argsort(-size, kind="stable")  # the words that go on are the first ones
    start, size = start[order], size[order]
    h, out, at = np.full(len(start), 7, np.uint64), [], []
    for k in range(LONGEST):
        n = int(np.searchsorted(-size, -k))  # longer than k
        h[:n] = step(h[:n], codes[start[:n] + k])
        if k + 1 >= SHORTEST:
            out.append(cells_of(h[:n], k))
            at.append(start[:n])
    out.append(cells_of(h ^ (size.astype(np.uint64) << np.uint64(40)), 99))
    return np.concatenate(out), np.concatenate([*at, start])


def together(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and lower-cased pieces of texts, about PIECE characters a time."""
    docs, held, size = [], [], 0
    for k, text in enumerate(texts):
        for piece in pieces((text or "").lower()):
            docs.append(k)
            held.append(piece)
            size += len(piece)
            if size >= PIECE:
                yield docs, held
                docs, held, size = [], [], 0
    if held:
        yield docs, held


def features(texts: list[str | None], lm: Characters, memo: dict, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of texts, cells): the distinct cells of whole texts as they are read; only those ``kept``, if given."""
    found = [np.empty(0, np.int64)]
    for docs, held in together(texts):
        of = np.array(docs, np.int64)
        joined = APART_TEXTS.join(held)
        codes, classes = codes_of(joined)
        starts = np.cumsum([0, *(len(x) + len(APART_TEXTS) for x in held[:-1])])
        letter, read, whose = classes == 1, [], []
        for a, b, got in restored_spans(joined, codes, classes, lm, memo):
            letter[a:b] = False
            read.append(got)
            whose.append(a)
        parts = [(codes, letter, starts, of)]
        if read:
            codes, classes = codes_of(" ".join(read))
            owner = of[np.searchsorted(starts, whose, side="right") - 1]
            parts.append((codes, classes == 1, np.cumsum([0, *(len(x) + 1 for x in read[:-1])]), owner))
        for codes, letter, begins, owner in parts:
            cells, at = word_features(codes, letter)
            if kept is not None:
                some = kept[cells]
                cells, at = cells[some], at[some]
            found.append(owner[np.searchsorted(begins, at, side="right") - 1] * DIMS + cells)
    pairs = np.unique(np.concatenate(found))
    return pairs // DIMS, pairs % DIMS


@dataclass
class Model:
    lm: Characters
    weights: np.ndarray | None  # a number a cell, 0 where nothing was learned
    bias: float
    kept: np.ndarray | None = None

    def scores(self, texts: list[str | None], memo: dict) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        if self.kept is None:
            self.kept = self.weights != 0
        docs, cells = features(texts, self.lm, memo, self.kept)
        z = self.bias + np.bincount(docs, self.weights[cells].astype(np.float64), minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, per_class: int = 6000, seed: int = 23, least_z: float = 6.0, least_rows: int = 5) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    with small_batches(docs.sparkSession):
        return _train(docs, labels, per_class, seed, least_z, least_rows)


def _train(docs: DataFrame, labels: DataFrame, per_class: int, seed: int, least_z: float, least_rows: int) -> Model:
    spark = docs.sparkSession
    lm = characters(docs)
    told = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("long").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull()).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    told = told.where(fold(F.col("_id")) != 0)
    # dealt by id at every size; the table of labels is the side that is held
    learn = docs.select("doc_id", "text").where(fold(F.col("doc_id")) != 0).join(told.hint("shuffle_hash"), F.col("doc_id") == F.col("_id")).select("text", "toxic", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)).alias("h"))
    sizes = {r[0]: r[1] for r in learn.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(lm, None, 0.0)
    share = {k: min(1 << 30, -(-per_class * (1 << 30) // n)) for k, n in sizes.items()}
    shared = spark.sparkContext.broadcast(lm)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        counts, memo = np.zeros((2, DIMS), np.int32), {}
        names = ["f", "clean", "toxic", "h", "cells"]
        for batch in batches:
            toxics, hs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            docs, cells = features(batch.column(0).to_pylist(), shared.value, memo)
            for toxic in (0, 1):
                counts[toxic] += np.bincount(cells[np.array(toxics)[docs] == toxic], minlength=DIMS).astype(np.int32)
            cuts = np.searchsorted(docs, np.arange(len(toxics) + 1))
            picked = [(toxic, h, cells[cuts[k] : cuts[k + 1]].astype("<i4").tobytes()) for k, (toxic, h) in enumerate(zip(toxics, hs, strict=True)) if h < share[toxic]]
            if picked:
                none = pa.nulls(len(picked), pa.int32())
                toxic, h, cells = zip(*picked, strict=True)
                yield pa.RecordBatch.from_arrays([none, none.cast(pa.int64()), pa.array(toxic, pa.int64()), pa.array(h, pa.int64()), pa.array(cells, pa.binary())], names=names)
        at = np.flatnonzero(counts.any(0))
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[0, some], pa.int64()), pa.array(counts[1, some], pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary())], names=names)

    seen = materialize(learn.mapInArrow(read, "f int, clean long, toxic long, h long, cells binary"), "toxicity-seen")
    c, t = float(sizes[0]), float(sizes[1])
    p = (F.col("a") + F.col("b")) / (c + t)
    z = (F.col("b") / t - F.col("a") / c) / F.sqrt(p * (1 - p + 1e-9) * (1 / t + 1 / c))
    counted = seen.where("f IS NOT NULL").groupBy("f").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).where((F.col("a") + F.col("b") >= least_rows) & (F.abs(z) >= least_z))
    chosen = np.sort(counted.select("f").toArrow().column("f").to_numpy())  # at most DIMS numbers
    if not len(chosen):
        return Model(lm, None, 0.0)
    known = spark.sparkContext.broadcast(chosen)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.flatnonzero(np.isin(known.value, np.frombuffer(x.as_py(), "<i4"), assume_unique=True)).astype("<i4").tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], names=["toxic", "h", "cells"])

    sample = seen.where("f IS NULL").select("toxic", "h", "cells").mapInArrow(narrow, "toxic long, h long, cells binary").toArrow().to_pylist()
    rows = sorted(((r["h"], r["toxic"], r["cells"]) for r in sample))
    fit = [(at := np.frombuffer(cells, "<i4"), np.ones(len(at)), toxic) for _, toxic, cells in rows]
    w, b = fit_ftrl(fit, 2, epochs=20, alpha=0.5, l1=0.2, l2=0.01, dims=len(chosen))
    weights = np.zeros(DIMS, np.float32)
    weights[chosen] = w[:, 1] - w[:, 0]
    drawn = np.bincount([r[1] for r in rows], minlength=2)
    return Model(lm, weights, float(b[1] - b[0] + math.log(t / c) - math.log(max(1, drawn[1]) / max(1, drawn[0]))))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    keep_batches_small(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        memo: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist(), memo), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def restored(docs: DataFrame, lm: Characters) -> DataFrame:
    """doc_id, text as it is read."""
    keep_batches_small(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([restore(t.as_py(), shared.value, memo) for t in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


def detect(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, per_class)
    with small_batches(docs.sparkSession):
        out = materialize(scores(docs, model), "toxicity")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
