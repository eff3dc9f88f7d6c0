"""Null and repeated ids, tokenizers of other families, corpora without labels."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sightline.llm import jaccard, mixing, sstable

NEAR = [" ".join([*(f"w{k}" for k in range(60)), f"x{i}"]) for i in range(400)]


@pytest.mark.parametrize("key", [None, 7])
def test_sets_meet_texts_one_to_one(spark, monkeypatch, key):
    """400 near copies without an id of their own: as many rows of texts are read again, not the square."""
    seen = []
    cut = jaccard.materialize

    def counted(df, name):
        out = cut(df, name)
        if name == "jaccard-sets":
            seen.append((out.count(), out.select("node").distinct().count()))
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    df = spark.createDataFrame([(key, t) for t in NEAR], "doc_id long, text string")
    plain = jaccard.Join._sets

    def sets(self, nodes):
        some = nodes.count()
        joined = self.docs.select(F.col("doc_id"), F.xxhash64("text").alias("tx")).join(self.nodes.join(nodes, "node").select("node", F.col("doc_id").alias("d"), F.col("tx").alias("t")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tx") == F.col("t"))).count()
        assert joined == some
        return plain(self, nodes)

    monkeypatch.setattr(jaccard.Join, "_sets", sets)
    rows = jaccard.Join(df, 3, 90).result().collect()
    assert len(rows) == 400 and len({r.component_id for r in rows}) == 1
    assert all(n == nodes for n, nodes in seen) and seen


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_file(spark, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    texts = ["The Cat sat, on 12 mats.", None, "", "  It's\n\tÉCOLE 123 — ça <|endoftext|>", "漢字かな кот"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = 0
    for r in sstable.read_shards(sstable.write_shards(df, path, end_id=1)).orderBy("doc_id").collect():
        ids = [*lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_taken_by_brute_force(spark, docs):
    """Every document's words in the mix, from its place in its source's endless stream."""
    many = docs.unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:]))
    mix = mixing.Mix(many, bucket_rows=10)
    rows = mix.light.join(mix.placed.select("uid", "begin"), "uid", "left").collect()
    of = {n: (s, w) for n, s, w in zip(mix.names, mix.sizes, mix.words, strict=True)}
    spans, want = {}, []
    for r in rows:
        size, words = of[r.source]
        taken = 0
        if r.size:
            spans.setdefault(r.source, []).append((r.begin, r.size))
            epoch = 0
            while epoch * size < words:
                taken += max(0, min(epoch * size + r.begin + r.size, words) - (epoch * size + r.begin))
                epoch += 1
        want.append((r.doc_id, r.size, taken))
    for source, held in spans.items():  # the stream has no gap and no overlap
        at = 0
        for begin, size in sorted(held):
            assert begin == at
            at += size
        assert at == of[source][0]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    got = [(r.doc_id, r.size, r.taken) for r in mix.taken().collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({r.h for r in rows if r.doc_id is None}) > 30  # null ids don't share a bucket


def test_pipeline_without_labels_and_ids(spark, docs, tmp_path):
    spark.createDataFrame([(1, "none of these words stands there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lettered = lambda df: {r.text for r in df.collect() if r.text and any(map(str.isalpha, r.text))}
    bare = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    kept = pipeline.language(spark, bare, str(tmp_path))
    assert {r.text for r in kept.collect()} == lettered(bare)
    labelled = pipeline.language(spark, docs, str(tmp_path))
    assert {r.text for r in labelled.collect()} == lettered(docs)
    bare.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() > 0
