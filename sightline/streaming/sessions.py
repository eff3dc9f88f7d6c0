"""Phrases by gaps and wake gates with a sliding time to live, by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def phrases(chunks: DataFrame, gap: str = "1.2 seconds", late: str | None = None) -> DataFrame:
    """Sessions of loud chunks (device, ts, level already filtered), batch or streaming."""
    rows = chunks.withWatermark("ts", late) if late else chunks
    return rows.groupBy("device", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("device", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def wake_gate(events: DataFrame, ttl: float = 45.0) -> DataFrame:
    """device, ts, woke -> verdict: 'woke', 'speak' while awake, else 'ignore'. Each accepted event keeps it awake for ttl seconds.

    An event is awake when a wake word came before it and no gap since then reaches ttl:
    runs of gaps below ttl, each speaking from its first wake word on.
    """
    t = F.col("ts").cast("double")
    w = Window.partitionBy("device").orderBy("ts", "event_id")
    # gaps count between accepted events, which are all events after a wake word within the run
    fresh = F.when(F.coalesce(t - F.lag(t).over(w), F.lit(1e18)) >= ttl, 1).otherwise(0)
    runs = events.withColumn("run", F.sum(fresh).over(w))
    inside = Window.partitionBy("device", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    awake = F.coalesce(F.max(F.col("woke").cast("int")).over(inside), F.lit(0)) == 1
    return runs.withColumn("verdict", F.when(F.col("woke"), "woke").when(awake, "speak").otherwise("ignore")).drop("run")
