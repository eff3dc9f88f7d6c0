"""What the driver holds."""

import numpy as np
from pyspark.sql.classic.dataframe import DataFrame

from sightline.llm import langid, sstable
from sightline.llm.queries import tokenizer_path


def test_counts_are_packed_in_few_bytes():
    for largest in (1, 255, 256, 65_535, 65_536, 1 << 33):
        found, counts = np.array([0, 5, langid.DIMS - 1]), np.array([1, 2, largest])
        f, n, width = langid.packed(found, counts)
        a, b = langid.unpacked(f, n, width)
        assert a.tolist() == found.tolist() and b.tolist() == counts.astype(np.float32).tolist()
        assert len(f) == 6 and len(n) == 3 * width and (width == 1) == (largest < 256)
    assert [len(x) for x in langid.unpacked(*langid.packed(np.empty(0, int), np.empty(0, int)))] == [0, 0]


def test_sample_comes_to_the_driver_by_partitions(spark, docs, monkeypatch):
    """No collect of the driver brings all of the sample's features at once; a feature takes three bytes in a short text, not eight."""
    collect, stream, whole, sent = DataFrame.collect, DataFrame.toLocalIterator, [], []

    def seen(df):
        whole.extend(c for c, kind in df.dtypes if kind == "binary")
        return collect(df)

    def streamed(df, *a):
        for r in stream(df, *a):
            sent.append((len(r.f) // 2, len(r.f) + len(r.n)))
            yield r

    monkeypatch.setattr(DataFrame, "collect", seen)
    monkeypatch.setattr(DataFrame, "toLocalIterator", streamed)
    model = langid.train(docs.select("doc_id", "text", "lang"))
    assert model.langs == ["en", "fr"] and not whole
    assert sent and all(b == 3 * n for n, b in sent if n < 200)


def test_the_encoder_holds_its_model_once():
    own = sstable.WordEncoder(tokenizer_path())
    own.lib.model.dropout = 0.25
    assert own.units.model.dropout == 0.25


def test_the_library_gets_distinct_words_in_groups(monkeypatch):
    own, seen = sstable.WordEncoder(tokenizer_path()), []
    units = own.units

    class Spy:
        def encode_batch_fast(self, texts, **more):
            seen.extend(len(t.split()) for t in texts)
            return units.encode_batch_fast(texts, **more)

    own.units = Spy()
    monkeypatch.setattr(sstable, "WORDS", 3)
    for text in ("one two three four five six seven one two eight", "café don't one two three four 12 five", "", "one two three", "don't"):
        assert own.encode(text).tolist() == own.lib.encode(text, add_special_tokens=False).ids
    assert len(seen) == 7 and max(seen) == 3
