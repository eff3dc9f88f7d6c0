"""Cutting a plan's lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_LOCAL: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: below spark.checkpoint.dir, or, in a local session without one, below a temporary folder."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="sightline-"))
        base = "file://" + _LOCAL[0]
    path = f"{base.rstrip('/')}/sightline-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
