"""Dictionary joins against the per-term fold, and misspelled words against a comparison with every known word."""

import difflib
import random
import string

from pyspark.sql import functions as F

from sightline.functions import requests
from sightline.functions.text import OBJECT_WORDS
from sightline.operators import dictionary

WORDS = sorted({w for w in OBJECT_WORDS if " " not in w})


def test_terms_like_the_fold(spark):
    r = random.Random(3)
    words = [*OBJECT_WORDS, "the", "near", "my", "old", "a"]
    texts = [(i, " ".join(r.choice(words) + r.choice(["", "", "s", ",", "!"]) for _ in range(r.randint(0, 9)))) for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    order = sorted(OBJECT_WORDS, key=len, reverse=True)
    terms = spark.createDataFrame([(w, OBJECT_WORDS[w], k) for k, w in enumerate(order)], "term string, value string, rank int")
    got = {x.id: x["values"] for x in dictionary.found(df, terms, ["id"]).collect()}
    want = {x.id: x.s.found for x in df.where("text is not null").select("id", requests.spoken_names(F.col("text"), OBJECT_WORDS).alias("s")).collect()}
    odd = [i for i in want if (got.get(i) or []) != want[i]]
    # the fold joins what stands around a word it has taken out; a term across such a gap is no term
    assert len(odd) <= 0.02 * len(texts), [(texts[i][1], got.get(i), want[i]) for i in odd[:5]]


def test_a_hundred_thousand_terms(spark):
    terms = spark.range(100_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("term"), F.col("id").cast("string").alias("value"), F.col("id").cast("int").alias("rank"))
    texts = spark.range(2000).select("id", F.concat_ws(" ", F.lit("see"), F.concat(F.lit("word"), (F.col("id") * 37 % 100_000).cast("string")), F.lit("and word999999")).alias("text"))
    assert dictionary.found(texts, terms, ["id"]).where(F.col("values")[0] == (F.col("id") * 37 % 100_000).cast("string")).count() == 2000


def mangled(r, w):
    w = list(w)
    for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
        k = r.randrange(len(w) + 1)
        match r.randrange(3):
            case 0:
                w.insert(k, r.choice(string.ascii_lowercase[:6]))
            case 1 if w:
                w.pop(min(k, len(w) - 1))
            case _ if w:
                w[min(k, len(w) - 1)] = r.choice(string.ascii_lowercase)
    return "".join(w)


def test_nearly_finds_all(spark):
    r = random.Random(9)
    long = ["".join(r.choice("abcde") for _ in range(n)) for n in (14, 15, 16, 17, 18, 22, 30, 31) for _ in range(6)]
    known = WORDS + long
    words = sorted({mangled(r, r.choice(known)) for _ in range(1500)})
    got = {(x.word, x.term) for x in dictionary.nearly(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in known], "term string")).collect()}
    want = set()
    for w in words:
        best = difflib.get_close_matches(w, known, n=1, cutoff=0.84) if len(w) >= 5 else []
        if best and abs(len(best[0]) - len(w)) <= 1:
            want.add((w, best[0]))
    assert got == want and len(want) > 300


def test_nothing(spark):
    none = spark.createDataFrame([], "word string")
    known = spark.createDataFrame([("bottle",), ("",)], "term string")
    assert dictionary.nearly(none, known).count() == 0
    assert dictionary.nearly(spark.createDataFrame([("botle",), ("",), (None,)], "word string"), known).collect()[0].term == "bottle"
