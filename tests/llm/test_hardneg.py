"""Hard negatives against brute force, on awkward rows and small blocks."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sightline.llm import hardneg, queries

from .test_sql import agree

SCHEMA = "vec_id long, label int, embedding array<double>, score int, block string"


def brute(rows, scale=256, every=50, positives=5, negatives=3):
    ready = []
    for vec_id, label, v, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clip = lambda x: max(-(2**63 - 1024), min(2**63 - 1024, math.floor(x * scale) if abs(x * scale) < 2**70 else math.copysign(2**63 - 1024, x)))
        ready.append((vec_id, label, [int(clip(x)) for x in v]))
    out = []
    for a, own, q in ready:
        if a % every:
            continue
        scored = [(max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, v)))), i, label) for i, label, v in ready if i != a]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in scored if s[2] == own][:positives]:
            some = [s for s in scored if s[2] != own and 50 * ps <= 100 * s[0] <= 95 * ps][:negatives]
            out += [(a, p, k + 1, n, ps, s) for k, (s, n, _) in enumerate(some)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def rows_of(n=400, dims=7):
    r = random.Random(3)
    rows = [(i, r.choice([0, 0, 0, 0, 1, 2, 3]), [r.uniform(0.1, 1) for _ in range(dims)], i, "x") for i in range(n)]
    rows += [(i, 1, [0.5] * dims, None, None) for i in range(1000, 1030)]  # equal vectors
    rows += [(2000, 1, None, 1, ""), (2050, None, [1.0], 1, ""), (None, 1, [1.0] * dims, 1, ""), (2100, 0, [float("nan")] * dims, 1, ""), (2150, 0, [None, 1.0], 1, ""), (2200, 0, [float("inf")], 1, ""), (2250, 0, [], 1, ""), (2300, 1, [0.7, 0.9], 1, "")]
    return rows


def test_brute_force_on_small_blocks(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert want
    assert found(hardneg.mine(df, size=32, anchor_size=3, chunk=2)) == want
    assert found(hardneg.mine(df)) == want


def test_scores_beyond_64_bits(spark):
    rows = [(i, i % 2, [1e17 * (1 + i % 5), -1.0 * i], 0, "") for i in range(60)] + [(100, 0, [3e30, 1.0], 0, ""), (150, 1, [-3e30, 1.0], 0, "")]
    assert found(hardneg.mine(spark.createDataFrame(rows, SCHEMA), chunk=1)) == brute(rows)


def test_tiles_round_trip():
    r = np.random.default_rng(1)
    for tile in (r.integers(-(2**62), 2**62, (7, 9)), r.integers(-99, 99, (3, 1)), np.array([[0, -1, 1, 2**62 - 1, -(2**62)]])):
        assert np.array_equal(hardneg.read_tile(*hardneg.pack_tile(tile.astype("<i8")), tile.shape), tile)


def test_repeated_rows(spark):
    base = rows_of(60)
    got = found(hardneg.mine(spark.createDataFrame(base + [base[50]], SCHEMA)))
    assert got == sorted(brute(base) + [r for r in brute(base) if r[0] == 50])


def test_one_label_and_nothing(spark):
    rows = [(i, 4, [1.0, i / 100], 0, "") for i in range(101)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(hardneg.mine(df)) == []
    assert found(hardneg.mine(df.where("vec_id < 0"))) == []


def test_sql_on_awkward_rows(spark, tmp_path):
    df = spark.createDataFrame(rows_of(300), SCHEMA).where("vec_id < 2250").withColumn("embedding", F.col("embedding").cast("array<float>"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    agree(spark, "op11_summa_negatives", tmp_path)
    assert "op11_summa_negatives" in queries.QUERIES
