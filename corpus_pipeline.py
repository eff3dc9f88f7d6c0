"""Corpus pipeline: language, near copies, benchmark leaks, mixture, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet and hands what it reads back to the next. All but the last return the
columns of documents, whatever these are.

Null and empty texts, and texts without a letter, leave in the first stage. Null and
repeated doc_ids are documents like any other, and are told apart by their texts. Rows
alike in all columns are near copies of each other: one stays, as of any group, that with
the smallest doc_id (ties: any). An empty table stays empty through all stages, and
gives no shards. Very long texts pass whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, jaccard, langid, mixing, sstable
from sightline.llm.common import materialize
from sightline.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and nothing else: where no language can be learned, all others stay."""
    columns = docs.columns
    model = langid.train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row"))
    told = langid.predict(rows, model, "text", "row")
    kept = told.where(F.col("lang_pred") != "und") if model.langs else told.where(F.col("text").rlike(r"\p{L}"))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at 0.8 on five-word shingles, one stays."""
    return jaccard.distinct_documents(docs, 5, 80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token shards' digest, a row a document."""
    return sstable.read_shards(sstable.write_shards(docs, tokenizer_path(), end_id=1))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("mixture", mixture), ("token_shards", token_shards)]

#: Tokenizing and a fitted model have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
