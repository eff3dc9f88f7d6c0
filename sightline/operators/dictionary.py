"""Dictionary matching for vocabularies of any size: the dictionary is a table, and texts meet it in joins.

``found`` looks every run of words of a text up (as many words as the longest term has)
and takes longer terms before shorter ones, each word once. ``nearly`` finds the likeliest
known word for a misspelled one by the ratio of matching blocks (2 M / T): pairs that can
reach the cutoff share a subsequence of a length that hangs on both lengths alone, so
words meet on what deletions leave of them; long ones, where that would be much, on any
three letters in a row. What meets is compared exactly, so no pair is missed. The cost is
that of the joins: it grows with what is matched, not with texts times terms.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import padded

CUTOFF, LEAST = 0.84, 5  # fixed values: of the ratio, of letters of a misspelled word
SHORT = 16  # letters up to which deletions are listed


def found(texts: DataFrame, terms: DataFrame, by: list[str], text: str = "text", plural: bool = True) -> DataFrame:
    """by and ``values``: what the terms (term, value, rank) in each text stand for, longest term first, of equally long ones that of lower rank.

    Terms are words, in lower case, with a blank between; with ``plural`` an s may follow.
    Rows are told apart by ``by``; those without a term are missing.
    """
    endings = ["", "s"] if plural else [""]
    forms = terms.select("value", "rank", F.length("term").alias("size"), F.explode(F.array(*[F.concat(F.trim(padded(F.col("term"))), F.lit(e)) for e in endings])).alias("form"))
    forms = forms.groupBy("form").agg(F.min(F.struct(-F.col("size"), "rank", "value")).alias("t")).withColumn("n", F.size(F.split("form", " ")))
    most = forms.agg(F.max("n")).first()[0] or 1
    words = texts.select(*by, F.split(F.trim(padded(F.col(text))), " ").alias("w"))
    last = F.least(F.lit(most), F.size("w") - F.col("i"))
    runs = words.select(*by, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i")).select(*by, "w", "i", F.explode(F.sequence(F.lit(1), last)).alias("n"))
    runs = runs.select(*by, "i", F.col("n").alias("k"), F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("form"))
    hits = runs.join(forms.drop("n"), "form")
    item = F.struct(F.col("t.col1").alias("size"), F.col("t.rank").alias("rank"), F.col("i"), (F.col("i") + F.col("k")).alias("to"), F.col("t.value").alias("value"))
    held = hits.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("hits"))  # one text's
    free = lambda kept, x: ~F.exists(kept, lambda y: (y["i"] < x["to"]) & (x["i"] < y["to"]))
    empty = F.filter("hits", lambda x: F.lit(False))
    kept = F.aggregate("hits", empty, lambda kept, x: F.when(free(kept, x), F.array_append(kept, x)).otherwise(kept))
    return held.select(*by, F.array_distinct(F.transform(kept, lambda x: x["value"])).alias("values"))


def shared(size: Column, other: Column, cutoff: float = CUTOFF) -> Column:
    """Letters that words of these lengths have in common, in order, where their ratio reaches the cutoff."""
    return F.ceil(F.round(F.lit(cutoff) / 2 * (size + other), 9)).cast("int")


def _shorter(words: Column) -> Column:
    """All that is left of words without one of their letters."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 0, one(w)).otherwise(F.array().cast("array<string>")))))


def _signatures(words: DataFrame, word: str, mine: str, theirs: str, cutoff: float) -> DataFrame:
    """word, key: what meets. Of lengths up to SHORT: both lengths and a common subsequence; else three letters in a row."""
    rows = words.withColumn("l", F.length(word))
    low, high = F.ceil(F.round(F.col("l") * cutoff / (2 - cutoff), 9)).cast("int"), F.floor(F.round(F.col("l") * (2 - cutoff) / cutoff, 9)).cast("int")
    near = rows.where(F.col("l") <= SHORT).withColumn("o", F.explode(F.sequence(F.greatest(low, F.lit(1)), F.least(high, F.lit(SHORT))))).withColumn("gone", F.col("l") - shared(F.col("l"), F.col("o"), cutoff))
    near = near.where("gone >= 0")
    parts = None
    left = F.array(F.col(word))
    for k in range(SHORT - shared_least(SHORT, cutoff) + 1):
        own = near.where(F.col("gone") == k).select(word, F.concat_ws(":", F.col("l" if mine == "a" else "o"), F.col("o" if mine == "a" else "l")).alias("lengths"), F.explode(left).alias("s")).select(word, F.concat_ws("|", "lengths", "s").alias("key"))
        parts = own if parts is None else parts.unionByName(own)
        left = _shorter(left)
    long = rows.where(F.length(word) >= 3).where(high > SHORT).select(word, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.substr(F.col(word), i, F.lit(3))))).alias("key"))
    return parts.unionByName(long).distinct()


def shared_least(size: int, cutoff: float) -> int:
    """The least number of common letters of a word of ``size`` letters with any that it can match."""
    import math

    shortest = math.ceil(round(size * cutoff / (2 - cutoff), 9))
    return math.ceil(round(cutoff / 2 * (size + shortest), 9))


def nearly(words: DataFrame, known: DataFrame, cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """word, term, ratio: the known word (term) that each of ``words`` (word) of ``least`` letters or more most nearly spells; of equal ones the last in order.

    Words whose likeliest term differs in length by more than one letter spell nothing.
    """
    a = words.select("word").where(F.length("word") >= least).distinct()
    b = known.select("term").where(F.length("term") > 0).distinct()
    pairs = _signatures(a, "word", "a", "b", cutoff).join(_signatures(b, "term", "b", "a", cutoff), "key").select("word", "term").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, last = difflib.SequenceMatcher(), None
        for batch in batches:
            ratios = []
            for word, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word != last:
                    matcher.set_seq2(word)
                    last = word
                matcher.set_seq1(term)
                ratios.append(matcher.ratio())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratios, pa.float64())], names=["word", "term", "ratio"])

    told = pairs.mapInArrow(run, "word string, term string, ratio double").where(F.col("ratio") >= cutoff)
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.col("ratio").desc(), F.col("term").desc()))
    first = told.withColumn("n", best).where("n = 1").drop("n")
    return first.where(F.abs(F.length("word") - F.length("term")) <= 1)
