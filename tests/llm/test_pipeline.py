import zlib

import corpus_pipeline as pipeline
from sightline.llm import mixing


def test_pipeline(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, "b c d e f g h b c d e f g h b c"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, sizes = docs, []
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        sizes.append(now.count())
    told = {r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    first = pipeline.language(spark, docs, str(tmp_path)).collect()
    assert {r.text for r in first} <= told and len({r.text for r in first}) >= 0.9 * len(told)
    assert sizes[1] < sizes[0]
    shards = pipeline.token_shards(spark, now, str(tmp_path))
    assert shards.count() == now.count() == sizes[-1]
    assert pipeline.run(spark, str(tmp_path)).columns == shards.columns


def test_pipeline_of_nothing(spark, none, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_word_count(spark):
    df = spark.createDataFrame([("a  b\tc\n",), (None,), ("",), ("é x",)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(df.t)).collect()] == [3, 0, 0, 1]
    assert zlib.crc32(b"") == 0
