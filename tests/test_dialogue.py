"""Scripted conversations, turn by turn, in one replay; the machine's rules one by one."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import requests
from sightline.operators import relations, search
from sightline.streaming import dialogue as d

OBJS = "collection string, scene string, scene_ord int, place string, caption string, ord int, type string, color string, material string, size string, conf double, box struct<x1:double,y1:double,x2:double,y2:double>"


def thing(kind, color, box, conf=0.9, material="metal", size="medium"):
    return kind, color, material, size, conf, tuple(map(float, box))


#: collection -> frame, [(scene, place, caption, things)]
INDEXES = {
    "base": ((1200, 800), [
        ("office_01", "office", "A desk with a laptop and two bottles.", [thing("laptop", "silver", (430, 300, 780, 560)), thing("bottle", "black", (800, 300, 870, 520)), thing("bottle", "blue", (330, 330, 395, 530))]),
        ("classroom_01", "classroom", "Desks with a black bottle and a backpack.", [thing("bottle", "black", (250, 320, 320, 520)), thing("backpack", "blue", (480, 300, 760, 640))]),
        ("lounge_01", "lounge", "A sofa with a black backpack.", [thing("backpack", "black", (200, 280, 500, 620)), thing("umbrella", "red", (820, 250, 890, 620))]),
    ]),
    "near": ((4032, 3024), [("desk_01", "office", "a desk", [thing("laptop", "silver", (500, 500, 1500, 1200), 0.95, size="large"), thing("bottle", "black", (1550, 600, 1750, 1100)), thing("backpack", "black", (2800, 500, 3600, 1400), material="fabric", size="large"), thing("bottle", "black", (3650, 600, 3850, 1100))])]),
    "twins": ((4000, 3000), [("front", "703", "a desk", [thing("laptop", "gray", (500, 800, 1900, 1800), size="large"), thing("laptop", "gray", (2000, 800, 3400, 1800), size="large"), thing("bottle", "red", (3500, 900, 3700, 1500))])]),
    "low": ((1200, 800), [("low_01", "office", "desk", [thing("keys", "silver", (100, 100, 140, 130), 0.42, size="small"), thing("phone", "black", (500, 400, 700, 600), 0.55, size="small")])]),
    "views": ((4000, 3000), [
        ("v1", "703", "", [thing("laptop", "blue", (100, 100, 2100, 1600), 0.95), thing("bottle", "green", (2500, 100, 2700, 900), material="glass")]),
        ("v2", "703", "", [thing("laptop", "gray", (100, 100, 500, 400), 0.5), thing("bottle", "green", (2500, 100, 2650, 700), material="plastic"), thing("phone", "black", (3000, 100, 3200, 300))]),
    ]),
}
DIALOGUES = {
    # name: (collection, turns, [(kind, asked_key, confidence, ids)])
    "golden": ("base", ["find the black bottle beside the laptop"], [("answer", None, "high", ["office_01_o1"])]),
    "colour then room": ("base", ["where is my bottle", "black", "the office"], [("question", "color", "medium", None), ("question", "location", "medium", None), ("answer", None, "high", ["office_01_o1"])]),
    "korean": ("base", ["내 물병 어딨어?", "검은색", "office"], [("question", "color", "medium", None), ("question", "location", "medium", None), ("answer", None, "high", ["office_01_o1"])]),
    "traditional": ("base", ["紅色的雨傘在哪裡"], [("answer", None, "high", ["lounge_01_o1"])]),
    "two in one": ("base", ["where is my bottle", "it was black, in the office"], [("question", "color", "medium", None), ("answer", None, "high", ["office_01_o1"])]),
    "new question": ("twins", ["find my laptop", "where is my bottle"], [("choose", d.PICK, None, ["front_o0", "front_o1"]), ("answer", None, "high", ["front_o2"])]),
    "number": ("twins", ["find my laptop", "2"], [("choose", d.PICK, None, ["front_o0", "front_o1"]), ("answer", None, None, ["front_o1"])]),
    "ordinal": ("twins", ["find my laptop", "the first one"], [("choose", d.PICK, None, None), ("answer", None, None, ["front_o0"])]),
    "none": ("twins", ["find my laptop", "none of them"], [("choose", d.PICK, None, None), ("none_found", None, None, [])]),
    "neither chosen": ("twins", ["find my laptop", "hm"], [("choose", d.PICK, None, None), ("giveup", None, "medium", ["front_o0", "front_o1"])]),
    "near": ("near", ["where is my bottle", "it was near the laptop"], [("question", "near", "medium", None), ("answer", None, "high", ["desk_01_o1"])]),
    "offered neighbour": ("near", ["where is my bottle", "backpack"], [("question", "near", "medium", None), ("answer", None, "high", ["desk_01_o3"])]),
    "explicit question wins": ("near", ["where is my bottle", "where is my laptop"], [("question", "near", "medium", None), ("answer", None, "high", ["desk_01_o0"])]),
    "low, yes": ("low", ["find my keys", "yes"], [("question", d.CONFIRM, "low", ["low_01_o0"]), ("answer", None, "low", ["low_01_o0"])]),
    "low, no": ("low", ["find my keys", "no"], [("question", d.CONFIRM, "low", None), ("none_found", None, None, [])]),
    "medium": ("low", ["find my phone"], [("answer", None, "medium", ["low_01_o1"])]),
    "no item": ("base", ["hello", "a red umbrella"], [("none_found", None, None, []), ("answer", None, "high", ["lounge_01_o1"])]),
    "absent": ("base", ["where are my glasses"], [("none_found", None, None, [])]),
    "all": ("base", ["list all the bottles"], [("list", None, None, ["office_01_o1", "office_01_o2", "classroom_01_o0"])]),
    "all of one kind": ("base", ["모든 가방 보여줘"], [("list", None, None, ["classroom_01_o1", "lounge_01_o0"])]),
    "unknown colour relaxes": ("base", ["where is my bottle", "purple"], [("question", "color", "medium", None), ("giveup", None, None, None)]),
    "no idea, then detail": ("base", ["where is my bottle", "i don't know", "the black one in the classroom"], [("question", "color", "medium", None), ("question", "location", "medium", None), ("answer", None, "high", ["classroom_01_o0"])]),
    "own word": ("views", ["where is my gray laptop"], [("answer", None, "high", ["v1_o0"])]),
    "any view": ("views", ["my green bottle", "mug", None], [("answer", None, "high", ["v1_o1"]), ("answer", None, "high", ["v1_o1"]), ("answer", None, "high", ["v1_o1"])]),
}


@pytest.fixture(scope="module")
def objs(spark):
    parts = []
    for name, (frame, scenes) in INDEXES.items():
        rows = [(name, s, at, place, caption, i + 1, *o) for at, (s, place, caption, things) in enumerate(scenes) for i, o in enumerate(things)]
        own = spark.createDataFrame(rows, OBJS)
        parts.append(search.with_relations(own, relations.edges(own, frame)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.cache()


def understood(spark, rows):
    places = {"office": [], "classroom": [], "lounge": [], "703": ["703호"]}
    return requests.understood(spark.createDataFrame(rows, "conv string, turn int, collection string, text string"), "text", places)


def test_dialogues(spark, objs):
    turns = understood(spark, [(name, i + 1, where, text) for name, (where, said, _) in DIALOGUES.items() for i, text in enumerate(said)])
    replies = d.replay(turns, objs)
    got = {(r.conv, r.turn): r for r in replies.collect()}
    assert len(got) == sum(len(said) for _, said, _ in DIALOGUES.values())
    for name, (_, _, want) in DIALOGUES.items():
        for i, (kind, key, confidence, ids) in enumerate(want, 1):
            r = got[name, i]
            assert (r.kind, r.asked_key) == (kind, key), (name, i, r)
            assert confidence is None or r.confidence == confidence, (name, i, r)
            assert ids is None or r.ids == ids, (name, i, r)
    text = {k: r.text for k, r in got.items()}
    assert text["golden", 1] == "Found it - the black bottle is in the office, beside the laptop."
    assert text["colour then room", 1].startswith("I found 3 possible matches. What colour is yours? (black or blue)\nCandidate A: ")
    assert got["colour then room", 2].options == ["office", "classroom"]
    assert "which one is yours" in text["number", 1] and "703" in text["none", 2]
    assert "medium-confidence" in text["medium", 1] and "low-confidence" in text["low, yes", 1]
    assert text["all", 1].count("\n") == 3 and text["unknown colour relaxes", 2].startswith('I couldn\'t find anything matching "purple".')
    assert text["own word", 1].startswith("Found it - the gray laptop is in the 703")
    local = {(r.conv, r.turn, r.l): r.said for r in replies.select("conv", "turn", F.explode(F.array(F.lit("ko"), F.lit("zh"), F.lit("en"))).alias("l"), "*").drop("text").withColumn("text", F.lit("plain")).select("conv", "turn", "l", *[c for c in replies.columns if c not in ("conv", "turn", "text")], "text").select("conv", "turn", "l", d.localized(F.col("l")).alias("said")).collect()}
    assert local["golden", 1, "ko"] == "찾았습니다. 검은색 물병이 office에서 노트북 옆에 있습니다."
    assert local["golden", 1, "zh"] == "找到了。黑色水瓶在office笔记本电脑旁边。"
    assert local["colour then room", 1, "ko"] == "3개를 찾았습니다. 무슨 색인가요? (검은색 아니면 파란색)"
    assert local["absent", 1, "ko"] == "안경을 찾지 못했습니다. 촬영 범위 밖이거나 가려져 있을 수 있습니다."
    assert local["no item", 1, "zh"].startswith("我不确定") and local["absent", 1, "en"] == "plain"


def test_stream_answers_like_a_replay(spark, objs, tmp_path):
    names = ["colour then room", "number", "all"]
    rows = [(n, i + 1, DIALOGUES[n][0], text) for n in names for i, text in enumerate(DIALOGUES[n][1])]
    first, rest = [r for r in rows if r[1] == 1], [r for r in rows if r[1] > 1]
    for k, part in enumerate((first, rest)):
        understood(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        schema = spark.read.parquet(f"{tmp_path}/in").schema
        q = d.stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), objs, f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None and k >= 0
    got = sorted((r.conv, r.turn, r.kind, tuple(r.ids)) for r in spark.read.parquet(f"{tmp_path}/out/replies").collect())
    want = sorted((r.conv, r.turn, r.kind, tuple(r.ids)) for r in d.replay(understood(spark, rows), objs).collect())
    assert got == want


def said(**more):
    base = dict.fromkeys(["target_type", "color", "predicate", "anchor_type", "location", "phrase", "relation", "size", "material", "number"])
    return base | {"low": "", "types": [], "colors": [], "opens": False, "all": False, "unknowing": False, "yes": False, "sure": False, "no": False, "none": False, "digits": False} | more


def talk(**more):
    return d.opened(said(target_type="bottle")) | more


def test_rules_of_answers():
    s = talk(key="color", options=["black", "blue"])
    d.answered(s, said(low="black, it's a metal charger", colors=["black"], material="metal", types=["charger"]))
    assert s["learned"] == {"material": ["metal", False], "color": ["black", False]} and s["asked"] == ["color"]
    s = talk(key="color", options=["black", "blue"])
    d.answered(s, said(low="black, near my laptop", colors=["black"], types=["laptop"], phrase="near", relation="near"))
    assert s["learned"]["near"] == ["laptop", False]
    s = talk(key="color", options=["black"])
    d.answered(s, said(low="left of my laptop", types=["laptop"], phrase="left of", relation="left_of"))
    assert not s["learned"]
    s = talk(key="location", options=["office", "lounge"])
    d.answered(s, said(low="black", colors=["black"]))
    assert s["asked"] == [] and s["learned"] == {"color": ["black", False]}
    s = talk(key="size", options=["medium", "small"])
    d.answered(s, said(low="it was in the classroom", location="classroom"))
    assert s["location"] == "classroom"
    s = talk(key="material", options=["wood"])
    d.answered(s, said(low="no", no=True))
    assert s["learned"] == {"material": ["wood", True]}
    s = talk(key="near", options=["umbrella", "charger"])
    assert not d.is_new_question(s, said(target_type="phone", types=["phone"]))
    d.answered(s, said(low="phone", target_type="phone", types=["phone"]))
    assert s["learned"] == {"near": ["phone", False]} and s["target"] == "bottle"
    s = talk(key=d.PICK, options=["a", "b"], shown=[{"id": "a"}, {"id": "b"}])
    d.answered(s, said(low="the green one", color="green", colors=["green"]))
    assert s["learned"] == {"color": ["green", False]} and s["picked"] is None
    assert d.choose(talk(key=d.PICK, options=["a"]), 3) is None
    one = d.choose(talk(key=d.PICK, options=["a"], shown=[{"id": "a", "place": "x", "type": "t", "color": None, "predicate": None, "anchor": None}]), 0)
    assert one[1]["kind"] == "answer" and one[1]["ids"] == ["a"]


def test_turns_run_out():
    found = [{"n": i, "score": 0.9, "band": "high", "place": f"p{i}", "scene": "s", "ord": i, "type": "bottle", "color": f"c{i}", "material": None, "size": None, "seen": [], "near": None, "predicate": None, "anchor": None} for i in (1, 2)]
    s, kinds = talk(), []
    for _ in range(5):
        s, r = d.decide(s, {"0": found})
        kinds.append((r["kind"], r["asked_key"]))
        s["asked"].append(s["key"])
        s["key"] = None
    assert kinds == [("question", "color"), ("question", "location"), ("choose", d.PICK), ("giveup", None), ("giveup", None)]


def test_second_look(spark):
    rows = [(1, 1, 0.9, (0.0, 0.0, 50.0, 50.0), 1000, 800), (1, 2, 0.6, (0.0, 0.0, 500.0, 500.0), 1000, 800), (1, 3, 0.9, (0.0, 0.0, 500.0, 500.0), 1000, 800), (1, 4, 0.9, (0.0, 0.0, 5.0, 5.0), None, 0)]
    df = spark.createDataFrame(rows, "rid int, n int, score double, box struct<x1:double,y1:double,x2:double,y2:double>, w int, h int")
    assert [r[0] for r in df.orderBy("n").select(search.needs_look(F.col("score"), F.col("box"), F.col("w"), F.col("h"))).collect()] == [True, True, False, False]
    box = spark.createDataFrame([((100.0, 100.0, 200.0, 140.0),), ((990.0, 10.0, 1010.0, 20.0),), ((5.0, 5.0, 5.0, 5.0),)], "b struct<x1:double,y1:double,x2:double,y2:double>")
    assert [r[0] and tuple(r[0]) for r in box.select(search.crop(F.col("b"), F.lit(1000), F.lit(800))).collect()] == [(65, 86, 235, 154), (983, 6, 1000, 23), None]
    verdicts = spark.createDataFrame([(1, 1, True, False, 0.9), (1, 2, True, False, 0.3), (1, 3, False, None, None), (1, 4, True, None, None), (2, 1, True, False, 0.7), (2, 2, True, False, 0.6)], "rid int, n int, looked boolean, match boolean, confidence double")
    got = search.kept_by_verdict(verdicts.withColumn("id", F.col("n")), ["rid"]).orderBy("rid", "n").collect()
    assert [(r.rid, r.id) for r in got] == [(1, 3), (1, 2), (1, 4), (2, 1), (2, 2)]
    assert [r.n for r in search.fresh(verdicts, verdicts.where("n <> 2 or rid = 2"), ["rid", "n"]).collect()] == [2]


def doubtful(spark, frame_known=False):
    """The base index with bottles that are seen at 0.5."""
    frame, scenes = INDEXES["base"]
    rows = [("base", s, at, place, caption, i + 1, *o) for at, (s, place, caption, things) in enumerate(scenes) for i, o in enumerate(things)]
    own = spark.createDataFrame(rows, OBJS).withColumn("conf", F.when(F.col("type") == "bottle", 0.5).otherwise(F.col("conf")))
    own = own.withColumn("w", F.lit(frame[0])).withColumn("h", F.lit(frame[1])) if frame_known else own
    return search.with_relations(own, relations.edges(own, frame))


class Look:
    """A model of second looks that remembers what it was asked."""

    def __init__(self, rejects, confidence=0.9):
        self.rejects, self.confidence, self.calls = rejects, confidence, []

    def __call__(self, cands):
        self.calls.append(sorted(cands.collect(), key=lambda r: (r.conv, r.id)))
        return cands.withColumn("match", ~F.expr(self.rejects)).withColumn("confidence", F.lit(self.confidence))


def looked(spark, rows, look, objs=None):
    replies = d.replay(understood(spark, rows), doubtful(spark) if objs is None else objs, look=look).collect()
    return {(r.conv, r.turn): r for r in replies}


def test_look_drops_what_is_surely_rejected(spark):
    look = Look("scene = 'classroom_01'")
    got = looked(spark, [("a", 1, "base", "where is my black bottle")], look)
    assert {r.description for r in look.calls[0]} == {"black bottle"}
    assert got["a", 1].ids == ["office_01_o1"]
    unsure = looked(spark, [("a", 1, "base", "where is my black bottle")], Look("scene = 'classroom_01'", 0.59))
    assert sorted(unsure["a", 1].ids) == ["classroom_01_o0", "office_01_o1"]


def test_each_object_is_looked_at_once_a_conversation(spark):
    look = Look("scene = 'classroom_01'")
    got = looked(spark, [("a", 1, "base", "where is my bottle"), ("a", 2, "base", "black"), ("b", 1, "base", "where is my black bottle"), ("b", 2, "base", "where is my umbrella"), ("b", 3, "base", "where is my black bottle")], look)
    asked = [(r.conv, r.id) for call in look.calls for r in call]
    assert sorted(asked) == [("a", i) for i in ("classroom_01_o0", "office_01_o1", "office_01_o2")] + [("b", i) for i in ("classroom_01_o0",) * 2 + ("office_01_o1",) * 2]  # a new question forgets
    assert not any(r.conv == "a" for call in look.calls[1:] for r in call)
    assert got["a", 2].ids == ["office_01_o1"] and got["b", 1].ids == got["b", 3].ids == ["office_01_o1"]


def test_looks_never_take_everything(spark):
    got = looked(spark, [("a", 1, "base", "where is my black bottle"), ("l", 1, "base", "list all the bottles")], Look("true"))
    assert sorted(got["a", 1].ids) == ["classroom_01_o0", "office_01_o1"] and len(got["l", 1].ids) == 3


def test_only_doubtful_things_are_looked_at(spark, objs):
    look = Look("true")
    got = looked(spark, [("a", 1, "base", "where is my black bottle"), ("k", 1, "low", "find my keys")], look, objs)
    assert [(r.conv, r.id, tuple(r.crop)) for call in look.calls for r in call] == [("k", "low_01_o0", (86, 89, 154, 140))]
    assert got["k", 1].kind == "question" and len(got["a", 1].ids) == 2
    small = Look("true")
    looked(spark, [("u", 1, "base", "where is my umbrella"), ("x", 1, "base", "where is my red backpack")], small, doubtful(spark, True))
    assert [(r.id, r.description, tuple(r.crop)) for call in small.calls for r in call if r.conv == "u"] == []  # 2.7 percent of its picture
    tiny = Look("false")
    looked(spark, [("u", 1, "base", "where is my bottle")], tiny, doubtful(spark, True))
    assert all(tuple(r.crop)[2] > tuple(r.crop)[0] for call in tiny.calls for r in call) and len(tiny.calls[0]) == 3


def test_states_are_written_for_those_who_speak(spark, objs, tmp_path, monkeypatch):
    """Deltas a batch, full tables now and then, and a batch that is run twice."""
    monkeypatch.setattr(d, "COMPACT", 2)
    batches = [[("a", 1, "base", "where is my bottle"), ("n", 1, "twins", "find my laptop")], [("a", 2, "base", "black")], [("n", 2, "twins", "2")], [("a", 3, "base", "the office")]]
    answer = d.answerer(objs, str(tmp_path))
    for k, rows in enumerate(batches):
        batch = understood(spark, rows)
        answer(batch, k)
        if k in (1, 2):
            answer(batch, k)  # as after a lost driver
        assert {r.conv for r in spark.read.parquet(f"{tmp_path}/states/{k}").collect()} == {r[0] for r in rows}
    got = sorted((r.conv, r.turn, r.kind, tuple(r.ids)) for r in spark.read.parquet(f"{tmp_path}/replies").collect())
    want = sorted((r.conv, r.turn, r.kind, tuple(r.ids)) for r in d.replay(understood(spark, sum(batches, [])), objs).collect())
    assert got == want and {r.conv for r in spark.read.parquet(f"{tmp_path}/bases/2").collect()} == {"a", "n"}
