"""From model texts to scenes."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions import jsonx
from sightline.operators import cleanup, indexing

WHOLE = '{"n_objects": 2, "objects": [{"type": "Laptop", "color": "grey", "bbox": [10, 20, 300, 400], "confidence": 0.8}, {"type": "cup", "bbox": [1, 2, 3]}], "caption": "a desk"}'
ANSWERS = {
    # name: (text, types, truncated, n_objects, caption)
    "clean": (WHOLE, ["Laptop", "cup"], False, 2, "a desk"),
    "fenced": (f"```json\n{WHOLE}\n```", ["Laptop", "cup"], False, 2, "a desk"),
    "chatty": (f"Sure {{:-)}}! Here it is: {WHOLE} Anything else?", ["Laptop", "cup"], False, 2, "a desk"),
    "cut": (WHOLE[: WHOLE.index('"cup"') + 3], ["Laptop"], True, 2, None),
    "cut in a box": ('{"caption": "x", "objects": [{"type": "a", "bbox": [1, 2, 3, 4]}, {"type": "b", "bbox": [1, 2', ["a"], True, None, "x"),
    "braces in strings": ('{"objects": [{"type": "a } b", "bbox": [1, 2, 3, 4]}, {"type": "c{", "bbox": [', ["a } b"], True, None, None),
    "no box": ('{"objects": [{"type": "a"}, {"type": "b", "bbox": [1,2,3,4]}, {"ty', ["b"], True, None, None),
    "nested objects stay inside": ('{"objects": [{"type": "a", "bbox": [1,2,3,4], "attributes": {"color": "red", "bbox": [9,9,9,9]}}, {"t', ["a"], True, None, None),
    "escapes": ('{"objects": [{"type": "a\\"\\u0041", "bbox": [1,2,3,4]}, {', ['a"A'], True, None, None),
    "empty": ("", None, None, None, None),
    "null": (None, None, None, None, None),
    "refusal": ("I can't see any objects.", None, None, None, None),
    "malformed box": ('here: {"objects": [{"type": "a", "bbox": ["x", 2, null, 4]}]}', ["a"], False, None, None),
    "odd types": ('x {"n_objects": "two", "objects": [1, {"type": 5, "bbox": "no"}], "caption": 3}', [None], False, None, None),
}


def test_answers(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in ANSWERS.items()], "name string, raw string")
    got = {r.name: r for r in jsonx.with_answer(df, "raw", "a").select("name", "a", jsonx.miscounted(F.col("a")).alias("miscounted")).collect()}
    for name, (_, types, truncated, n, caption) in ANSWERS.items():
        a = got[name].a
        assert (a.objects and [o.type for o in a.objects]) == types, name
        assert (a.truncated, a.n_objects, a.caption) == (truncated, n, caption), name
    assert [k for k, r in got.items() if r.miscounted] == ["cut"]
    assert got["nested objects stay inside"].a.objects[0].color == "red"


def test_deep_and_long_text():
    assert jsonx.extract("{" * 5000) is None and jsonx.extract('{"objects": ' + "[" * 5000) is None


def picture(scene, path, w=1000, h=1000):
    return scene, path, w, h, 500, 500


PICTURES = "scene string, path string, width int, height int, seen_w int, seen_h int"


def test_batches_fall_back_to_single_pictures(spark, tmp_path):
    log = f"{tmp_path}/calls"

    def make():
        def model(items):
            with open(log, "a") as f:
                f.write(f"{len(items)}\n")
            if len(items) > 1:
                raise RuntimeError("no memory")
            if "bad" in items[0][0]:
                raise ValueError("broken")
            return indexing.dummy(items)

        return model

    rows = spark.createDataFrame([picture(f"s{i}", f"/p/{n}.jpg") for i, n in enumerate(("mug", "bad", "pen"))], PICTURES).coalesce(1)
    got = {r.path: r for r in indexing.described(rows, make, "what is there?", 2).collect()}
    assert [got[f"/p/{n}.jpg"].failure for n in ("mug", "bad", "pen")] == [None, "ValueError: broken", None]
    assert got["/p/pen.jpg"].raw.count("pen") == 1 and open(log).read().split() == ["2", "1", "1", "1"]
    fine = indexing.described(rows, indexing.load_model("dummy"), "", 2).collect()
    assert all(r.failure is None for r in fine)
    with pytest.raises(ValueError, match="no such model"):
        indexing.load_model("none")


def test_passes_to_scenes(spark):
    texts = {
        ("s1", 0): '{"objects": [{"type": "notebook computer", "color": "Grey", "bbox": [100, 100, 500, 500], "confidence": 0}, {"type": "desk", "bbox": [0, 0, 900, 900]}, {"type": "pen", "bbox": [10, 10, 20, 20]}, {"type": "mug", "bbox": [600, 600, 601, 700]}, {"type": "cup", "bbox": [1, 2, 3]}, {"type": "sample", "bbox": [110, 220, 330, 440]}]}',
        ("s1", 1): '{"objects": [{"type": "laptop", "color": "silver", "bbox": [170, 170, 850, 850], "confidence": 0.7}, {"type": "phone", "bbox": [700, 100, 1000, 300], "confidence": 0.9}]}',
        ("s1", 4): '{"objects": [{"type": "phone", "bbox": [300, 300, 500, 500], "confidence": 0.6}]}',
        ("s2", 0): 'Two: {"objects": [{"type": "pen", "bbox": [100, 100, 200, 300]}, {"type": "book", "bbox": [210, 110, 400, 290]}]}',
        ("s2", 1): "nothing to see",
    }
    pictures = spark.createDataFrame([picture("s1", "a.jpg"), picture("s2", "b.jpg")], PICTURES)
    passes = indexing.passes_of(pictures, 2)
    assert passes.groupBy("scene").count().collect()[0]["count"] == 5
    raw = spark.createDataFrame([(s, k, t) for (s, k), t in texts.items()], "scene string, pass_no int, raw string")
    passes = passes.join(raw, ["scene", "pass_no"], "left")
    objs, edges = indexing.scenes_of(passes, "norm1000", [(110, 220, 330, 440)])
    got = sorted(tuple(r) for r in objs.select("scene", "ord", "type", "color", "conf", "box.x1", "box.y1", "box.x2", "box.y2").collect())
    # the tile's laptop is larger in its own frame and stays; its phone lies at the tile's inner edge and goes
    tile = cleanup.tiles(F.lit(1000), F.lit(1000), 2)
    t = spark.range(1).select(tile.alias("t")).first().t
    assert [r[:5] for r in got] == [("s1", 1, "pen", None, 0.5), ("s1", 2, "laptop", "silver", 0.7), ("s1", 3, "phone", None, 0.6), ("s2", 1, "pen", None, 0.5), ("s2", 2, "book", None, 0.5)]
    assert got[1][5:] == (100.0, 100.0, 499.8, 499.8) and t[0].x1 == 588
    assert got[2][5] == pytest.approx(t[3].x0 + 0.3 * (t[3].x1 - t[3].x0), abs=0.06)
    assert {(r.scene, r.a, r.predicate, r.b) for r in edges.collect()} >= {("s2", 1, "beside", 2), ("s2", 2, "beside", 1)}


def test_finish_drops_patterns_and_doubles(spark):
    grid = [("s", 1000 + i, "charger", None, None, None, 0.9, (1000.0 + 80 * (i % 11), 1000.0 + 90 * (i // 11), 1070.0 + 80 * (i % 11), 1076.0 + 90 * (i // 11)), 0.1, 4032, 3024) for i in range(22)]
    rows = grid + [("s", 2000, "Laptop".lower(), "gray", None, None, 0.5, (10.0, 10.0, 500.0, 500.0), 0.1, 4032, 3024), ("s", 2001, "laptop", "blue", "metal", None, 0.8, (15.0, 10.0, 500.0, 500.0), 0.1, 4032, 3024), ("s", 2002, "tissue", None, None, None, 0.8, (900.0, 10.0, 950.0, 50.0), 0.1, 4032, 3024)]
    df = spark.createDataFrame(rows, "scene string, ord int, type string, color string, material string, size string, conf double, box struct<x1:double,y1:double,x2:double,y2:double>, rel_size double, width int, height int")
    got = [(r.ord, r.type, r.color, r.material, r.conf) for r in indexing.finished(df).collect()]
    assert got == [(1, "laptop", "blue", "metal", 0.8)]


def test_build_keeps_what_is_not_selected(spark):
    known = spark.createDataFrame([("a_1", 1), ("b_1", 2)], "scene_id string, v int")
    pictures = spark.createDataFrame([("a_1", "a", "a/1.jpg"), ("c_1", "c", "c/1.jpg"), ("a_2", "a", "a/2.jpg")], "scene_id string, location string, path string")
    ids = lambda x: sorted(r.scene_id for r in x.collect())
    stay, todo = indexing.build(known, pictures, limit=1)
    assert (ids(stay), ids(todo)) == (["a_1", "b_1"], ["a_2"])
    stay, todo = indexing.build(known, pictures, force=True)
    assert (ids(stay), ids(todo)) == (["b_1"], ["a_1", "a_2", "c_1"])


def test_spread_right_on_the_limit(spark):
    """Widths whose spread is exactly half of their mean, in an order in which running means miss it by a rounding."""
    widths = [118, 82, 62, 108, 62, 50, 22, 24]
    rows = spark.createDataFrame([(1, float(w)) for w in widths], "k int, w double").coalesce(1)
    rows = rows.select("k", g.box(F.lit(0), F.lit(0), F.col("w"), F.lit(10)).alias("box"))
    assert rows.groupBy("k").agg((F.stddev_pop("box.x2") / F.avg("box.x2")).alias("cv")).first().cv > 0.5
    got = cleanup.textures(rows, ["k"], spread=0.5, hull=9.0).collect()
    assert [(r.k, r.n, r.cv_w, r.cv_h) for r in got] == [(1, 8, 0.5, 0.0)]


def test_plain_values_read_as_others(monkeypatch):
    """Python's scanner and the tolerant reader give the same wherever a text tears; pairs of surrogates are one letter."""
    texts = [WHOLE, 'Sure: {"a": NaN, "objects": [{"bbox": [1.5, -2, 3e1, 0]}]}', '{"objects": [{"bbox": [01], "type": "a\\\\q\\"b"}, {"bbox": [[[]]]}]}', '{"objects": [' + "[" * 70 + "]" * 70 + ', {"bbox": []}]}']
    torn = [t[:n] for t in texts for n in range(len(t) + 1)]
    fast = [jsonx.extract(t) for t in torn]
    assert jsonx.extract('{"objects": [{"bbox": [], "type": "\\ud83d\\ude00"}')["objects"] == [{"bbox": [], "type": "\U0001f600"}]
    monkeypatch.setattr(jsonx.Reader, "plain", lambda self, depth: None)
    assert [jsonx.extract(t) for t in torn] == fast


def test_counts_need_no_relations(spark, monkeypatch):
    from sightline.plans import queries

    def never(*_):
        raise AssertionError("nobody names a relation")

    monkeypatch.setattr(queries.relations, "edges", never)
    assert queries.candidate_counts(spark, "/root/testdata/sf0.001").count() > 0
