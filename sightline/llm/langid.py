"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* features: hashed 1- to 3-grams of lower-cased characters, every non-letter a blank,
  over whole texts; (1 + log tf) * idf, scaled to unit length;
* document frequencies: counted over *all* rows that may be learned from;
* training: follow-the-regularised-leader (proximal, per coordinate) with L1 and L2
  penalties, on about ``per_lang`` rows a language (a documented bound; the rows are
  picked by a seeded hash of doc_id and text, so alike at every size and on every run);
* calibration: one temperature, fitted on a fifth of that sample held back from training.

Rows may be learned from when lang isn't null, doc_id isn't null and crc32(doc_id as
text) mod 4 isn't 2. A prediction sees the text alone. Null texts and texts without a
letter are ``und`` with score 0. With nothing to learn from, every text is ``und``. An
empty table gives no rows; columns beside doc_id, text and lang, whatever their names,
play no part. Repeated rows have equal predictions; a very long text is read in pieces.
A null doc_id has a null ``held_out``. The rows are only mapped: no shuffle, no skew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, give_back, keep_batches_small, materialize, mix64, small_batches

DIMS = 1 << 15
PIECE = 1 << 19
_BLANK = np.uint64(32)


def _letters() -> np.ndarray:
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


_TABLE: list[np.ndarray] = []


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a whole text; a long text comes piece by piece, each with the last two characters kept before it, so cuts change nothing."""
    if not _TABLE:
        _TABLE.append(_letters())
    total, last = np.zeros(DIMS, np.int64), np.empty(0, np.uint64)
    for at in range(0, max(1, len(text)), PIECE):
        piece = text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass")
        c = np.concatenate([last, _TABLE[0][np.frombuffer(piece, "<u4")].astype(np.uint64)])
        kept = np.ones(len(c), bool)
        kept[1:] = (c[1:] != _BLANK) | (c[:-1] != _BLANK)  # runs of blanks are one
        c, back = c[kept], len(last)
        two, three = c[:-1] * np.uint64(0x110000) + c[1:] if len(c) > 1 else c[:0], c[:0]
        if len(c) > 2:
            three = (two[:-1] * np.uint64(0x110000) + c[2:]) ^ np.uint64(1 << 63)
        for grams, new in ((c, back), (two, max(0, back - 1)), (three, 0)):
            total += np.bincount((mix64(grams[new:]) >> np.uint64(49)).astype(np.int64), minlength=DIMS)
        last = c[-2:]
    found = np.flatnonzero(total)
    return found, total[found]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMS x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[found]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        found, counts = gram_counts(text)
        p = softmax((self.vector(found, counts) @ self.weights[found] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate proximal FTRL; rows are (features, values, class). Weights and bias."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))

    def weights(at):
        zz, penalty = z[at], np.append(np.full(len(at) - 1, l1), 0.0)[:, None]
        return np.where(np.abs(zz) <= penalty, 0.0, -(zz - np.sign(zz) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            found, values, y = rows[k]
            at, x = np.append(found, dims), np.append(values, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    out = np.concatenate([weights(np.append(np.arange(a, min(a + 4096, dims)), dims))[:-1] for a in range(0, dims, 4096)])
    return out, weights(np.array([dims]))[0]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(1e-12, softmax(logits / np.exp(t))[np.arange(len(y)), y])).mean()
    a, b, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def packed(found: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, int]:
    """Features in two bytes each, counts in as few bytes as the largest takes; that number of bytes."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return found.astype("<u2").tobytes(), counts.astype(kind.newbyteorder("<")).tobytes(), kind.itemsize


def unpacked(f: bytes, n: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(f, "<u2"), np.frombuffer(n, f"<u{width}").astype(np.float32)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, per_lang: int = 1500, seed: int = 17) -> Model:
    """``docs``: doc_id, text, lang. Document frequencies come from all learnable rows, the fit from about per_lang rows a language."""
    with small_batches(docs.sparkSession):
        model = _train(docs, per_lang, seed)
    give_back()  # the sample's rows
    return model


def _train(docs: DataFrame, per_lang: int, seed: int) -> Model:
    learn = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2))
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30))
    langs = {r[0]: r[1] for r in learn.groupBy("lang").count().collect()}
    names = sorted(langs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        df, rows = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if has_letter(text := text.as_py()):
                    df[gram_counts(text)[0]] += 1
                    rows += 1
        at = np.append(np.flatnonzero(df), DIMS)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.append(df[at[:-1]], rows), pa.int64())], names=["f", "n"])

    df = np.zeros(DIMS + 1)
    for f, n in learn.select("text").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n")).collect():  # at most DIMS + 1 rows
        df[f] = n
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1
    share = F.lit(0)
    for name, n in langs.items():
        share = F.when(F.col("lang") == name, F.lit(min(1 << 30, -(-per_lang * (1 << 30) // n)))).otherwise(share)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            rows = [(*packed(*gram_counts(t)), lang, h) for t, lang, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int8(), pa.string(), pa.int64()))], names=["f", "n", "width", "lang", "h"])

    # about 2 KB a row, a partition at a time: the driver never holds the sample in the JVM
    sample = materialize(learn.where(spread < share).select("text", "lang", spread.alias("h")).mapInArrow(featurise, "f binary, n binary, width byte, lang string, h long"), "language-sample")
    told = sorted(sample.toLocalIterator(), key=lambda r: (r.h, r.lang, bytes(r.n), bytes(r.f)))
    discard(sample)
    model = Model(names, idf.astype(np.float64), np.zeros((DIMS, len(names))), np.zeros(len(names)))
    rows = []
    for r in told:
        f, n = unpacked(r.f, r.n, r.width)
        rows.append((f, model.vector(f, n).astype(np.float32), names.index(r.lang), r.h))
    del told
    fit, held = [r[:3] for r in rows if r[3] % 5], [r for r in rows if r[3] % 5 == 0]
    if fit:
        model.weights, model.bias = fit_ftrl(fit, len(names))
        model.temperature = fit_temperature(np.array([x @ model.weights[f] + model.bias for f, x, *_ in held]), np.array([r[2] for r in held], int))
    return model if fit else Model([], idf, model.weights, model.bias)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score of their text."""
    spark = docs.sparkSession
    keep_batches_small(spark)
    shared = spark.sparkContext.broadcast(Model(model.langs, model.idf.astype(np.float32), model.weights.astype(np.float32), model.bias, model.temperature))  # DIMS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(batch.columns if with_text else batch.columns[1:]), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*(["text"] if with_text else []), "kept", "lang_pred", "score"])

    with_text = "text" in keep  # it goes there and back once
    rows = docs.select("text", F.struct(*[k for k in keep if k != "text"]).alias("kept"))
    out = T.StructType([*(rows.schema.fields if with_text else rows.schema.fields[1:]), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out).select(*(["text"] if with_text else []), "kept.*", "lang_pred", "score")


def identify(docs: DataFrame, per_lang: int = 1500) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    with small_batches(docs.sparkSession):
        out = materialize(predict(rows, train(rows, per_lang), "doc_id"), "languages")
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
