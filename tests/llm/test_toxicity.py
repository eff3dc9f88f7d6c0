"""Toxicity: the channel against enumeration, the model by held-out rows, awkward input."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import queries, toxicity

TEXTS = ["the idiot and the moron went on with this worthless thing", "a clown is there and on that", "all is well on the hill and in the book", "stupid trash"] * 30


def model_of(texts):
    counts = np.zeros(toxicity.GRAMS)
    codes, classes = toxicity.codes_of(" ".join(texts))
    for grams in toxicity._grams(codes, classes):
        np.add.at(counts, grams, 1)
    return toxicity.Characters(counts.astype(np.float32), float(counts.sum() / 4))


@pytest.fixture(scope="module")
def lm():
    return model_of(TEXTS)


def path_cost(path, lm):
    context, cost, out = " ", 0.0, ""
    for c, price in path:
        cost += price
        if c and not (c == " " and context[-1] == " "):
            cost += lm.cost(context, c)
            context = (context + c)[-3:]
            out += c
    return cost, out.strip()


@pytest.mark.parametrize("span", ["1d10t", "m0-r", "a  b", "$tu", "aaab", "7h3", "c|0wn", "x.y"])
def test_decode_is_the_best_of_all_paths(lm, span):
    options = [*toxicity.readings(span), [(" ", 0.0)]]
    least = min(path_cost(p, lm)[0] for p in itertools.product(*options))
    got = toxicity.decode(span, lm)
    assert least == pytest.approx(min(path_cost(p, lm)[0] for p in itertools.product(*options) if path_cost(p, lm)[1] == got))


@pytest.mark.parametrize(("seen", "read"), [("1d10t", "idiot"), ("i d i o t", "idiot"), ("idiooot", "idiot"), ("m0r0n", "moron"), ("$tupid", "stupid"), ("tr@sh", "trash"), ("c.l.o.w.n", "clown"), ("w0rthle$s", "worthless")])
def test_restores(lm, seen, read):
    assert toxicity.restore(f"the {seen} and", lm) == f"the {read} and"


def test_leaves_plain_text(lm):
    text = "the book, all is well! (on the hill) 12 of 3.5 and\n\nthere*** is%%% well!!"
    assert toxicity.restore(text, lm) == text


def test_scalar_and_vector_cells_agree():
    codes, classes = toxicity.codes_of("éab")
    one, two, three, four = toxicity._grams(codes, classes)
    assert [one[1], two[0], three[0], four[0], four[1]] == [toxicity.cell(g) for g in ("é", " é", " éa", " éab", "éab ")]


def test_pieces_change_nothing(lm, monkeypatch):
    text = " ".join(["the 1d10t and a b c d e x", "i d i o t of", "w"] * 40)
    cells = lambda: toxicity.features([None, text, "x"], lm, {})
    whole = cells(), toxicity.restore(text, lm)
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert len(list(toxicity.pieces(text))) > 5 and "".join(toxicity.pieces(text)) == text
    assert all(map(np.array_equal, whole[0], cells())) and toxicity.restore(text, lm) == whole[1]


def test_texts_read_together_are_read_alone(lm):
    texts = ["a b", "c d e the", None, "1d10t", "i d", "i o t", "", "on\0with", "the m0r0n\n", "$"]
    docs, cells = toxicity.features(texts, lm, {})
    for k, text in enumerate(texts):
        assert np.array_equal(cells[docs == k], toxicity.features([text], lm, {})[1])


def test_slices_change_nothing(monkeypatch):
    whole = model_of(TEXTS[:9]).counts
    monkeypatch.setattr(toxicity, "SLICE", 5)
    assert np.array_equal(whole, model_of(TEXTS[:9]).counts)


def corpus(spark):
    bad = ["idiot", "moron", "clown", "scum"]
    texts = [f"the {bad[i % 4]} went {'on' * (i % 5)} with the {bad[i % 3]} and all" if i % 4 == 0 else f"the man went {'on' * (i % 5)} with the book and all {i % 7}" for i in range(400)]
    docs = [(i, t, "x", "y") for i, t in enumerate(texts)]
    labels = [(i, 0, int(i % 4 == 0)) for i in range(400)] + [(0, 1, 0), (None, 0, 1), (1, 0, None), (9999, 0, 1), (2, 0, 7)]
    docs += [(1000, "you 1d10t, m0r0n", "", ""), (1001, None, "", ""), (1002, "", None, None), (None, "the idiot and moron", "", ""), (1003, "the man " * 200_000, "", ""), (1000, "you 1d10t, m0r0n", "", ""), (1004, "i d i o t   m o r o n", "", "")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_awkward_rows(spark):
    docs, labels = corpus(spark)
    rows = toxicity.detect(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out is None if r.doc_id is None else r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())
    assert all((min(by[i]) >= 0.5) == (i % 4 == 0) for i in range(400))
    assert min(by[1000]) >= 0.5 and min(by[1004]) >= 0.5 and min(by[None]) >= 0.5
    assert by[1001] == by[1002] and max(by[1001] | by[1003]) < 0.5


def test_nothing_to_learn_and_nothing_to_score(spark):
    docs, labels = corpus(spark)
    assert {r.score for r in toxicity.detect(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in toxicity.detect(docs, labels.where("doc_id < 0")).collect()} == {0.0}
    assert toxicity.detect(docs.where("doc_id < 0"), labels).count() == 0


def test_labels_lang_and_source_are_no_inputs(spark):
    docs, labels = corpus(spark)
    held = toxicity.fold(F.col("doc_id")) == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = sorted((r.doc_id or -1, r.score) for r in toxicity.detect(docs, labels).collect())
    assert one == sorted((r.doc_id or -1, r.score) for r in toxicity.detect(docs.withColumn("score", F.lit("z")), flipped).collect())


def test_restored_texts(spark, lm):
    df = spark.createDataFrame([(1, "An 1D10T here"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, toxicity.restored(df, lm).collect())) == [(1, "an idiot here"), (2, "")]


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    told = queries.QUERIES["op13_noisy_channel_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    bad, good = [r.predicted for r in told if r.toxic == 1], [r.predicted for r in told if r.toxic == 0]
    assert len(bad) > 50 and sum(bad) / len(bad) > 0.85 and sum(good) / len(good) < 0.01
