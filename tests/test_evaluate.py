"""Cases played against small indexes by a simulated owner, and what is counted of them."""

import pytest
from pyspark.sql import functions as F

from sightline.functions.text import LOOK_ALIKE
from sightline.operators import evaluate as e

from .test_dialogue import INDEXES, objs  # noqa: F401  a fixture

CASE = "id string, collection string, query string, difficulty string, expect struct<location:string,type:string,color:string>, answers array<string>, known_gap boolean"
PLACES = {"office": [], "classroom": [], "lounge": [], "703": []}
#: name: (collection, query, difficulty, expect, answers, {column: value})
CASES = {
    "golden": ("base", "find the black bottle beside the laptop", "spatial", ("office", "bottle", "black"), None, dict(ok=True, asked=0, found="office_01_o1", false_answer=False, parse_ok=True)),
    "too sure": ("base", "find the black bottle beside the laptop", "ambiguous", ("office", "bottle", "black"), None, dict(ok=True, asked=0, false_answer=True)),
    "one question": ("base", "where is my bottle", "ambiguous", ("office", "bottle", "blue"), None, dict(ok=True, asked=1, found="office_01_o2", false_answer=False)),
    "two questions": ("base", "where is my bottle", "ambiguous", ("classroom", "bottle", "black"), None, dict(ok=True, asked=2, found="classroom_01_o0")),
    "script": ("base", "where is my bottle", "ambiguous", ("office", "bottle", "black"), ["black", "the office"], dict(ok=True, asked=2, found="office_01_o1")),
    "script runs out": ("base", "where is my bottle", None, None, ["i don't know"], dict(ok=False, asked=1, kind="question", difficulty="-")),
    "words": ("base", "where is my bottle", "ambiguous", (None, "water bottle", "blue"), None, dict(ok=True, asked=1, missing=False)),
    "missing": ("base", "where are my glasses", "easy", ("office", "glasses", None), None, dict(ok=False, missing=True, kind="none_found")),
    "nothing there": ("base", "where are my glasses", "not-found", None, None, dict(ok=True, missing=False, transparent_ok=True)),
    "wrong thing": ("base", "a red umbrella", "easy", ("office", "bottle", ""), None, dict(ok=False, missing=False, found="lounge_01_o1")),
    "no item": ("base", "hello", "easy", ("office", "bottle", None), None, dict(ok=False, parse_ok=False, transparent_ok=False)),
    "picture": ("twins", "find my laptop", "ambiguous", ("703", "laptop", "gray"), None, dict(ok=True, asked=1, kind="answer", found="front_o0")),
    "unsure": ("low", "find my keys", "small-object", ("office", "keys", None), ["yes"], dict(ok=True, asked=1, confidence_ok=False)),
    "other view": ("views", "where is my gray laptop", "easy", ("703", "laptop", "gray"), None, dict(ok=True, asked=0, found="v1_o0")),
    "neighbour": ("near", "where is my bottle", "ambiguous", ("office", "bottle", "black"), None, dict(ok=True, asked=1, kind="answer")),
    "gap": ("base", "where is my thingamajig", "vocab-gap", ("office", "bottle", None), None, dict(ok=False, known_gap=True)),
}


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(k, c, q, d, x, a, True if k == "gap" else None) for k, (c, q, d, x, a, _) in CASES.items()], CASE)


def test_cases(spark, objs, cases):  # noqa: F811
    results = e.play(cases, objs, PLACES).cache()
    got = {r.id: r.asDict() for r in results.collect()}
    assert set(got) == set(CASES) and results.count() == len(CASES)
    for name, (*_, want) in CASES.items():
        assert {k: got[name][k] for k in want} == want, (name, got[name])
    card = e.scorecard(results).first().asDict()
    scored = [r for r in got.values() if not r["known_gap"]]
    asked = [r["asked"] for r in scored if r["asked"]]
    assert card["cases"] == len(scored) == len(CASES) - 1 and card["gaps"] == 1 and card["gaps_closed"] == 0
    assert card["correct"] == sum(r["ok"] for r in scored) and card["missing"] == 1 and card["false_answers"] == 1
    assert card["clarified"] == sum(r["asked"] > 0 for r in scored if r["difficulty"] == "ambiguous") == card["ambiguous"] - 1
    assert (card["spatial"], card["spatial_correct"], card["small"], card["small_correct"]) == (1, 1, 1, 1)
    assert abs(card["avg_asked"] - sum(asked) / len(asked)) < 1e-6


def test_no_cases(spark, objs, cases):  # noqa: F811
    assert e.play(cases.limit(0), objs, PLACES).count() == 0
    assert e.scorecard(e.play(cases.limit(0), objs, PLACES)).first().avg_asked == 0.0


def test_targets_by_brute_force(spark, objs, cases):  # noqa: F811
    alike = lambda a, b: a == b or any(a in g and b in g for g in LOOK_ALIKE)
    plain = {"water bottle": "bottle"}
    want = set()
    for name, (where, _, _, expect, *_) in CASES.items():
        for scene, place, _, things in INDEXES[where][1] if expect else []:
            for i, (kind, color, *_) in enumerate(things):
                if expect[0] in (None, place) and alike(plain.get(expect[1], expect[1]), kind) and (not expect[2] or expect[2] == color):
                    want.add((name, f"{scene}_o{i}"))
    hits = e.targets(cases, objs)
    got = [(r[0], r[1]) for r in hits.select("id", e.object_id(F.col("scene"), F.col("ord"))).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    knows = {r.id: r for r in e.owners(hits).collect()}
    assert knows["picture"].owner == "front_o0" and knows["picture"].home == "703" and knows["picture"].knows["color"] == ["gray"]
    assert knows["neighbour"].knows["near"][0] == "laptop" and "missing" not in knows


def test_names(spark):
    rows = spark.createDataFrame([("water bottle", "in"), ("qqqq zzzz", "out"), (None, "in")], "type string, scope string")
    got = {r.type: (r.c, r.c_known) for r in e.with_canonical(rows, "type", "c").collect()}
    assert got == {"water bottle": ("bottle", True), "qqqq zzzz": ("qqqq zzzz", False), None: (None, False)}
    assert e.in_scope(rows).count() == 2
    assert spark.range(1).select(e.same_type(F.lit("mug"), F.lit("bottle")), e.same_type(F.lit("mug"), F.lit("keys"))).first()[:] == (True, False)
