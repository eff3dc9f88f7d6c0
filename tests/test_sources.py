"""Written indexes: round trips, resumed ingest, sound files, salvaged answers."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import audio, geometry, jsonx
from sightline.operators import search
from sightline.sources import index, scenes, sound

PICTURES = "scene_id string, location string, path string, width int, height int"


def answer(path):
    """A model's text that hangs on the picture's name alone: some tell of more, some are torn, some raise."""
    k = int(path.rpartition("_")[2].partition(".")[0])
    if k % 7 == 3:
        raise ValueError(f"no picture {k}")
    objects = [{"type": t, "color": "black", "material": "metal", "size": "small", "bbox": [100 + 250 * i, 100 + k, 300 + 250 * i, 400], "confidence": 0.5 + i / 10} for i, t in enumerate(["bottle", "laptop", "mug"][: 1 + k % 3])]
    text = json.dumps({"n_objects": len(objects), "objects": objects, "caption": f"picture {k}"})
    return text[:-20] if k % 5 == 4 else text if k % 11 else "nothing"


def make():
    return lambda items: [answer(p) for p, _ in items]


def pictures(spark, n=40):
    return spark.createDataFrame([(f"hall{i % 3}_{i}", f"hall{i % 3}", f"data/hall{i % 3}/p_{i}.jpg", 1200, 800) for i in range(n)], PICTURES)


def tables(spark, out):
    return {n: sorted(tuple(map(str, r)) for r in index.table(spark, out, n).drop("commit").collect()) for n in index.TABLES}


def test_resumed_ingest_gives_the_same_index(spark, tmp_path, monkeypatch):
    whole, torn = str(tmp_path / "whole"), str(tmp_path / "torn")
    assert index.resume(pictures(spark), whole, make, "", "abs_resized", at_once=100) == 1
    plain, calls = index.commit, []

    def dies(mine, out, number, *more):
        calls.append(number)
        if len(calls) == 3:  # in the middle of a commit: tables without a log entry
            mine.limit(0).write.mode("overwrite").parquet(f"{out}/commits/{number}/scenes")
            raise RuntimeError("lost")
        plain(mine, out, number, *more)

    monkeypatch.setattr(index, "commit", dies)
    with pytest.raises(RuntimeError):
        index.resume(pictures(spark), torn, make, "", "abs_resized", at_once=10)
    done = index.table(spark, torn, "scenes").count()
    assert 0 < done < index.table(spark, whole, "scenes").count()
    before = len(calls)
    index.resume(pictures(spark), torn, make, "", "abs_resized", at_once=10)
    assert calls[before] == 2 and tables(spark, torn) == tables(spark, whole)
    failed = {r.scene_id for r in index.table(spark, whole, "failures").collect()}
    assert failed == {f"hall{i % 3}_{i}" for i in range(40) if i % 7 == 3 or (i % 11 == 0 and i % 5 != 4)}
    assert index.resume(pictures(spark).where("scene_id = 'hall1_1'"), torn, make, "", "abs_resized") == 0


def test_selection_force_and_later_commits(spark, tmp_path):
    out = str(tmp_path)
    index.resume(pictures(spark), out, make, "", "abs_resized", only="hall1")
    assert {r.location for r in index.table(spark, out, "scenes").collect()} == {"hall1"}
    index.resume(pictures(spark), out, make, "", "abs_resized", limit=2)
    assert index.table(spark, out, "scenes").where("location = 'hall0'").count() == 1  # the first fails
    cured = lambda: (lambda items: ['{"objects": [{"type": "phone", "bbox": [1, 1, 90, 90], "confidence": 0.8}], "caption": "new"}' for _ in items])
    index.resume(pictures(spark), out, cured, "", "abs_resized", only="hall1", force=True)
    again = index.table(spark, out, "scenes").where("location = 'hall1'")
    assert {r.caption for r in again.collect()} == {"new"} and again.count() == 13
    assert {r.type for r in index.table(spark, out, "objects").join(again, "scene_id", "left_semi").collect()} == {"phone"}
    assert not {r.scene_id for r in index.table(spark, out, "failures").collect()} & {r.scene_id for r in again.collect()}
    assert index.resume(pictures(spark).limit(0), out, make, "", "abs_resized") == 0


def test_nested_index_round_trip(spark, tmp_path):
    out = str(tmp_path / "i")
    index.resume(pictures(spark, 9), out, make, "", "abs_resized")
    rows = index.nested(spark, out)
    doc = {"version": 1, "model": "m", "scenes": [json.loads(r) for r in rows.toJSON().collect()], "failures": []}
    (tmp_path / "index.json").write_text(json.dumps(doc))
    loaded = scenes.load(spark, str(tmp_path / "index.json"))
    strip = lambda df: sorted(json.dumps(json.loads(r), sort_keys=True) for r in df.drop("scene_ord").toJSON().collect())
    assert strip(loaded) == strip(rows) and loaded.count() == 7
    objs, edges = scenes.objects(loaded), scenes.edges(loaded)
    assert objs.count() == index.table(spark, out, "objects").count() and edges.count() == index.table(spark, out, "relations").count() > 0
    assert {r.subject for r in edges.collect()} <= {r.id for r in objs.collect()}
    scenes.save(loaded, str(tmp_path / "saved"))
    kept = spark.read.parquet(str(tmp_path / "saved"))
    assert kept.count() == 7 and scenes.ingest(kept, loaded).count() == 7 and scenes.ingest(kept.limit(2), loaded).count() == 7


def test_pictures_on_disk(spark, tmp_path):
    root = tmp_path / "data" / "images"
    assert index.unindexed(spark, str(root), spark.createDataFrame([], "scene_id string, image_path string")) is None
    for name in ("office/front.jpg", "office/office_table_01.jpg", "Home/home_desk_01.JPG", "Home/notes.txt", "Home/raw.webp"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    known = spark.createDataFrame([("office_front", "data/images/office/front.jpg"), ("x", None), ("y", str(root / "office/gone.jpg"))], "scene_id string, image_path string")
    missing = index.unindexed(spark, str(root), known)
    assert sorted(r.path for r in missing.collect()) == ["Home/home_desk_01.JPG", "office/office_table_01.jpg"]
    both = known.unionByName(spark.createDataFrame([("a", f"file://{root}/Home/home_desk_01.JPG"), ("b", str(root / "office/office_table_01.jpg"))], known.schema))
    assert index.unindexed(spark, str(root), both).count() == 0
    found = [(r.location, r.scene_id) for r in scenes.images(spark, str(root)).collect()]
    assert found == [("Home", "Home_home_desk_01"), ("Home", "Home_raw"), ("office", "office_front"), ("office", "office_table_01")]
    assert [r.scene_id for r in scenes.images(spark, str(root), "office").collect()] == ["office_front", "office_table_01"]
    sizes = spark.createDataFrame([(4032, 3024), (100, 50), (5000, 1)], "w int, h int").select(*scenes.resized(F.col("w"), F.col("h"), 1280)).collect()
    assert [tuple(r) for r in sizes] == [(1280, 960), (100, 50), (1280, 1)]


def test_lookups_and_paths(spark, tmp_path):
    rows = scenes.relative(F.col("p"), "/home/a/project")
    got = spark.createDataFrame([("/home/a/project/data/x.jpg",), ("file:///home/a/project/data/y.jpg",), ("/elsewhere/z.jpg",), ("/home/a/project2/z.jpg",)], "p string").select(rows).collect()
    assert [r[0] for r in got] == ["data/x.jpg", "data/y.jpg", "/elsewhere/z.jpg", "/home/a/project2/z.jpg"]
    df = spark.createDataFrame([("hall", "/d/hall/hall_1.jpg", 4000, 3000), ("hall", "/d/hall/door.png", 100, 50)], "location string, path string, width int, height int")
    assert [(r.scene_id, r.seen_w, r.seen_h) for r in scenes.prepared(df, 1000).collect()] == [("hall_1", 1000, 750), ("hall_door", 100, 50)]
    keys = spark.createDataFrame([("a", "o1"), ("b", "o9"), ("a", "o1")], "scene_id string, id string")
    objs = spark.createDataFrame([("a", "o1", 1), ("a", "o2", 2), ("b", "o1", 3)], "scene_id string, id string, v int")
    assert [r.v for r in scenes.object_of(objs, keys).collect()] == [1] and scenes.looked_up(objs, keys).count() == 3
    assert set(geometry.BINARY) | {"near"} == set(search.SAFE) | set(search.PICTURED) and not set(search.SAFE) & set(search.PICTURED)


def test_coverage(spark, tmp_path):
    assert index.coverage(spark, str(tmp_path)).first() == (0, [], 0, 0)
    index.resume(pictures(spark, 9), str(tmp_path), make, "", "abs_resized")
    (c,) = index.coverage(spark, str(tmp_path)).collect()
    assert (c.photos, c.locations, c.failures) == (7, ["hall0", "hall1", "hall2"], 2) and c.candidates == index.table(spark, str(tmp_path), "objects").count()
    (row,) = index.log(spark, str(tmp_path)).collect()
    assert row.created_at.endswith("+00:00") and (row.scenes, row.failures) == (7, 2)


def test_truth_and_cases(spark, tmp_path):
    (tmp_path / "truth.json").write_text(json.dumps({"locations": {"office": {"objects": [{"type": "bottle", "color": "black", "views": ["front"]}, {"type": "mug", "scope": "out"}]}}}))
    rows = scenes.truth(spark, str(tmp_path / "truth.json")).orderBy("ord").collect()
    assert [(r.location, r.ord, r.type, r.color, r.views, r.scope) for r in rows] == [("office", 0, "bottle", "black", ["front"], None), ("office", 1, "mug", None, None, "out")]
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "c1", "query": "my mug", "expect": {"location": "office", "type": "mug"}, "answers": ["white"], "known_gap": False}, {"note": "no case"}]))
    (case,) = scenes.cases(spark, str(tmp_path / "cases.json")).collect()
    assert (case.id, case.expect.type, case.expect.color, case.answers) == ("c1", "mug", None, ["white"])


def wav(path, samples, rate=16_000, channels=1, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2" if width == 2 else "u1").tobytes())


def test_sound_files(spark, tmp_path):
    spark.dataSource.register(sound.Sound)
    r = np.random.default_rng(1)
    a, b = r.integers(-20000, 20000, 16_000 * 3), r.integers(-9000, 9000, 44_100 * 2)
    wav(tmp_path / "in/kitchen/rec_1.wav", a)
    wav(tmp_path / "in/hall/rec_7.wav", b, 44_100, 2)
    wav(tmp_path / "in/hall/none_8.wav", a[:0])
    rows = spark.read.format("sound").option("path", str(tmp_path / "in")).option("seconds", 0.4).load().orderBy("device", "seq").collect()
    mine = [x for x in rows if x.device == "kitchen"]
    assert [x.seq for x in mine] == [1_000_000 + k for k in range(8)] and b"".join(bytes(x.pcm) for x in mine) == a.astype("<i2").tobytes()
    assert [round(x.seconds, 6) for x in mine] == [0.4] * 7 + [0.2]
    both = [x for x in rows if x.device == "hall"]
    want = audio.mono(b.astype("<i2").tobytes(), 2, 2)
    assert np.isclose(both[0].level, audio.level(want[:17640])) and sum(len(x.pcm) for x in both) == 2 * len(want) and both[0].rate == 44_100
    with pytest.raises(Exception, match="seconds"):
        spark.read.format("sound").option("path", str(tmp_path / "in")).option("seconds", 0).load().collect()


def test_sound_stream_goes_on_from_its_offset(spark, tmp_path, monkeypatch):
    spark.dataSource.register(sound.Sound)
    r = np.random.default_rng(2)
    for k in range(5):
        wav(tmp_path / f"in/d/rec_{k}.wav", r.integers(-500, 500, 16_000))
        if k in (1, 4):
            s = spark.readStream.format("sound").option("path", f"file://{tmp_path}/in").load()
            q = s.select("device", "seq", "level").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            q.awaitTermination()
            assert q.exception() is None
    got = sorted(x.seq for x in spark.read.parquet(f"{tmp_path}/out").collect())
    whole = sorted(x.seq for x in spark.read.format("sound").option("path", str(tmp_path / "in")).load().collect())
    assert got == whole and len(got) == 15


def test_salvaged_objects(spark):
    full = '{"n_objects": 2, "objects": [{"type": "mug", "bbox": [1, 2, 3, 4], "confidence": 0.5}, {"type": "pen", "color": "re}d", "bbox": [5, 6, 7, 8]}], "caption": "c"}'
    texts = [full[:k] for k in range(len(full) + 1)] + [None, "", "no", f"Sure: ```json {full} ``` bye"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    got = {}
    for r in jsonx.salvaged(df, "raw").collect():
        got.setdefault(r.id, []).append((r.ord, r.type, r.color, tuple(r.bbox), r.confidence, r.truncated))
    one, two = full.index("}") + 1, full.index("]}") + 2
    for i, text in enumerate(texts[: len(full) + 1]):
        want = 0 if i < one else 1 if i < two else 2
        assert len(got.get(i, [])) == want, (i, text)
        assert all(o[-1] == (i < len(full)) for o in got.get(i, []))
    assert got[len(texts) - 1] == [(1, "mug", None, (1.0, 2.0, 3.0, 4.0), 0.5, False), (2, "pen", "re}d", (5.0, 6.0, 7.0, 8.0), None, False)]
    assert jsonx.salvaged(df, "raw", outer=True).select("id").distinct().count() == len(texts)
