"""Phrases, wake gate and the chain: streams against tables against plain loops, in any batching and over restarts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import audio, words
from sightline.operators import relations, search
from sightline.streaming import voice

from .test_dialogue import INDEXES, OBJS

CHUNKS = "device string, seq long, seconds double, level double, talking boolean, rate int, pcm binary"


def noisy(device, seed, n=120):
    r, out, at = random.Random(seed), [], 0
    while at < n:
        loud, run = r.random() < 0.4, r.randint(1, 9)
        base = r.choice([0.0005, 0.002, 0.004, 0.006])
        for _ in range(min(run, n - at)):
            level = r.uniform(0.01, 0.2) if loud else base * r.uniform(0.5, 1.5)
            out.append((device, at, r.choice([0.4, 0.4, 0.4, 0.1, 0.0]), None if r.random() < 0.01 else level, r.random() < 0.01, 16000, bytes([at % 250, 0]) * 3))
            at += 1
    return out


def loop(rows):
    """The rule, told once more: a phrase opens with a loud chunk and closes behind 1.2 quiet seconds, or once 15 have passed since the last reset."""
    out, rooms = [], {}
    for device, seq, seconds, level, talking, _, pcm in sorted(rows, key=lambda r: (r[0], r[1])):
        d = rooms.setdefault(device, {"floor": None, "open": []})
        if not d["open"] and "total" not in d:
            d |= {"total": 0.0, "still": 0.0, "top": 0.0}
        if not seconds or level is None:
            continue
        clear = lambda: d.update({"open": [], "total": 0.0, "still": 0.0, "top": 0.0})  # noqa: E731, B023
        if talking:
            clear()
            continue
        d["total"] += seconds
        d["top"] = max(d["top"], level)
        f = d["floor"]
        d["floor"] = min(level, 0.004) if f is None else (0.7 * f + 0.3 * level if level < f else 0.97 * f + 0.03 * level)
        if level > max(0.004, 4.0 * d["floor"]):
            d["still"] = 0.0
            d["open"].append((seq, pcm))
        elif d["open"]:
            d["still"] += seconds
            d["open"].append((seq, pcm))
        else:
            continue
        if d["still"] >= 1.2 or d["total"] >= 15.0:
            if d["total"] - d["still"] >= 0.4 and d["top"] >= max(0.004, 5.0 * d["floor"]):
                out.append((device, d["open"][0][0], d["open"][-1][0], len(d["open"]), d["total"] - d["still"], d["top"], d["floor"], b"".join(p for _, p in d["open"])))
            clear()
    return out


def run_stream(spark, make, batches, path):
    """Each batch in a query of its own: every one goes on from the checkpoint, as after a restart."""
    schema = batches[0].schema
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(f"{path}/in")
        frame = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
        q = frame.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    return spark.read.parquet(f"{path}/out")


@pytest.fixture(scope="module")
def stream_spark(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", voice.STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


FIELDS = ["device", "first", "last", "n", "spoken", "peak", "room"]


@pytest.mark.parametrize("segment", [1 << 16, 25])
def test_table_fold_equals_the_loop(spark, segment):
    rows = [r for d in range(40) for r in noisy(f"d{d}", d)] + [(None, 1, 1.0, 0.5, False, 16000, b"")]
    want = loop([r for r in rows if r[0]])
    random.Random(1).shuffle(rows)
    got = voice.phrases_of(spark.createDataFrame(rows, CHUNKS), segment)
    assert want and sorted(tuple(r) for r in got.select(*FIELDS).collect()) == sorted(w[:7] for w in want)
    assert voice.phrases_of(spark.createDataFrame([], CHUNKS)).count() == 0


def test_stream_equals_table_on_a_thousand_devices(stream_spark, tmp_path):
    spark = stream_spark
    rows = [r for d in range(1000) for r in noisy(f"d{d}", d, 60)]
    cuts = [[r for r in rows if a <= r[1] < b] for a, b in ((0, 13), (13, 14), (14, 60))]
    got = run_stream(spark, voice.phrases_stream, [spark.createDataFrame(c, CHUNKS) for c in cuts], tmp_path).collect()
    assert sorted((*(r[f] for f in FIELDS), bytes(r.pcm)) for r in got) == sorted(loop(rows))
    batch = voice.phrases_of(spark.createDataFrame(rows, CHUNKS))
    assert sorted(tuple(r) for r in batch.select(*FIELDS).collect()) == sorted(tuple(r[f] for f in FIELDS) for r in got)


TEXTS = ["hey lopa", "헤이 로파, 내 가방 어딨어?", "blue", "嘿罗帕呀", "where did they go", "hello there", "嗨洛趴 我的水瓶在哪里", "hi", "Hey, Lopa! where is my bag", "노로파바", "", "trophy"]


def gate_loop(events, ttl, enabled):
    out, until = [], {}
    for device, seq, at, text, heard, rest, asks in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        awake = not enabled or at < until.get(device, float("-inf"))
        if heard or awake:
            until[device] = at + ttl
        verdict = ("speak" if asks else "woke") if heard else "speak" if awake else "ignore"
        out.append((device, seq, verdict, "" if verdict != "speak" else rest if heard else text))
    return sorted(out)


@pytest.mark.parametrize("enabled", [True, False])
def test_gate_in_any_batching(stream_spark, tmp_path, enabled):
    spark, r = stream_spark, random.Random(4)
    events, at = [], 0.0
    for seq in range(150):
        at += r.choice([1.0, 20.0, 44.0, 45.0, 46.0, 120.0])
        events.append((f"d{r.randint(0, 3)}", seq, at, r.choice(TEXTS)))
    heard = voice.called(spark.createDataFrame(events, "device string, seq long, at double, text string"), synonyms={"bag": ["bag"]}).cache()
    flat = [(e.device, e.seq, e.at, e.text, e.heard, e.rest, e.asks) for e in heard.collect()]
    want = gate_loop(flat, 45.0, enabled)
    assert len({w[2] for w in want}) == (3 if enabled else 2)
    assert sorted((e.device, e.seq, e.verdict, e.said) for e in voice.gate_of(heard, 45.0, enabled).collect()) == want
    parts = [heard.where(f"seq >= {a} AND seq < {b}") for a, b in ((0, 1), (1, 70), (70, 150))]
    got = run_stream(spark, lambda s: voice.gate_stream(s, 45.0, enabled), parts, tmp_path)
    assert sorted((e.device, e.seq, e.verdict, e.said) for e in got.collect()) == want


def test_names_and_requests(spark):
    told = {e.text: (e.heard, e.rest, e.asks) for e in voice.called(spark.createDataFrame([(t,) for t in [*TEXTS, "嘿羅帕 呀", *words.wake_names()]], "text string")).collect()}
    assert all(told[n][0] for n in words.wake_names()) and len(set(words.wake_names())) > 500
    assert told["嘿罗帕呀"] == (True, "呀", False) and told["嘿羅帕 呀"][0]
    assert told["헤이 로파, 내 가방 어딨어?"][1:] == ("내 가방 어딨어?", True)
    assert told["hey lopa"] == (True, "", False) and not told["where did they go"][0] and not told["trophy"][0]


def test_sound():
    ints = np.array([0, 16383, -16383, 32767], "<i2")
    assert np.allclose(audio.mono(ints.tobytes(), 2, 1), ints / 32767)
    assert np.allclose(audio.mono(ints.tobytes() + b"x", 2, 2), [(0 + 16383) / 2 / 32767, (-16383 + 32767) / 2 / 32767])
    assert np.allclose(audio.mono(bytes([128, 255, 1]), 1, 1), [0, 1, -1]) and len(audio.mono(b"", 2, 1)) == 0
    assert np.allclose(audio.mono(b"\xff\xff\x7f\x00\x00\x80", 3, 1), [1, -8388608 / 8388607])
    x = np.arange(48, dtype=np.float32)
    assert list(audio.resampled(x, 48_000)) == list(range(0, 48, 3)) and audio.resampled(x, 16_000) is x
    assert len(audio.resampled(x, 44_100)) == 17 and audio.level(np.array([-0.5, 0.25])) == 0.375


def test_sound_columns(spark):
    r = random.Random(1)
    rows = [(i, [r.randint(-32767, 32767) for _ in range(n)], c, rate) for i, (n, c, rate) in enumerate([(441, 1, 44_100), (97, 2, 48_000), (10, 1, 16_000), (0, 1, 8_000), (30, 1, 8_000)])]
    df = spark.createDataFrame(rows, "i int, x array<int>, c int, rate int").withColumn("m", audio.mono_column(F.col("x"), F.col("c")))
    for r in df.withColumn("s", audio.resampled_column(F.col("m"), F.col("rate"))).withColumn("l", audio.level_column(F.col("m"))).collect():
        want = audio.mono(np.array(rows[r.i][1], "<i2").tobytes(), 2, r.c)
        assert np.allclose(r.m, want, atol=1e-6) and np.isclose(r.l, audio.level(want), atol=1e-6)
        assert np.allclose(r.s, audio.resampled(want, r.rate), atol=1e-6)
    scores = spark.createDataFrame([({"ms": 0.9, "zh": 0.1, "ko": 0.3},), ({"fr": 1.0},), ({"zh": 0.5, "ko": 0.5},)], "s map<string,double>")
    assert [x[0] for x in scores.select(audio.best_understood(F.col("s"))).collect()] == ["ko", "en", "ko"]


SAID = ["hey lopa where is my bottle", "black", "the office", "mumbling"]


def sound_of(k, n=4):
    """A loud stretch whose level tells which sentence it is."""
    return [(0.1 + 0.1 * k, int((0.1 + 0.1 * k) * 32767))] * n


def hear(samples):
    loud = np.abs(samples).max() if len(samples) else 0
    return SAID[min(len(SAID) - 1, round((float(loud) - 0.1) / 0.1))]


def test_chain_from_sound_to_replies(stream_spark, tmp_path):
    spark, rows = stream_spark, []
    for device, sentences in (("a", [0, 1, 2]), ("b", [3, 0]), ("c", [2, 3])):
        seq = 0
        for k in sentences:
            for level, value in [(0.001, 30)] * 3 + sound_of(k) + [(0.001, 30)] * 4:
                rows.append((device, seq, 0.4, level, False, 16000, np.full(20, value, "<i2").tobytes()))
                seq += 1
    frame, scenes = INDEXES["base"]
    own = spark.createDataFrame([("base", s, at, place, caption, i + 1, *o) for at, (s, place, caption, things) in enumerate(scenes) for i, o in enumerate(things)], OBJS)
    objs = search.with_relations(own, relations.edges(own, frame)).cache()
    places = {"office": [], "classroom": [], "lounge": []}
    for a, b in ((0, 9), (9, 17), (17, 99)):  # a query each: restarts, the second in the middle of a phrase
        spark.createDataFrame([r for r in rows if a <= r[1] < b], CHUNKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        chunks = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = voice.replies(chunks, hear, objs, F.lit("base"), f"{tmp_path}/out", places).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    got = sorted((r.conv, r.turn, r.kind, r.asked_key, tuple(r.ids)) for r in spark.read.parquet(f"{tmp_path}/out/replies").collect())
    assert [(g[0], g[2], g[3]) for g in got] == [("a", "question", "color"), ("a", "question", "location"), ("a", "answer", None), ("b", "question", "color")]
    assert got[2][4] == ("office_01_o1",)
