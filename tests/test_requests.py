"""Requests, answers and replies in words, case by case."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import requests as r

PLACES = {"7f_tearoom": ["7층 탕비실"], "8f_lobbytable": [], "703": ["703호실"]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Where is my black laptop next to the water bottle?", ("laptop", "black", "beside", "bottle", None)),
        ("it should be laptop, not skateboard", ("laptop", None, None, None, None)),
        ("beside the laptop, a bottle", ("laptop", None, "beside", "bottle", None)),
        ("can you help me to find my red bottle, it might be in the tearoom", ("bottle", "red", None, None, "7f_tearoom")),
        ("Whereismylaptop", ("laptop", None, None, None, None)),
        ("where is the umbrela", ("umbrella", None, None, None, None)),
        ("my keys on the book", ("keys", None, "on", "book", None)),
        ("grey flask w/ a card on top of my notebook computer", ("tumbler", "gray", "on", "laptop", None)),
        ("탕비실", (None, None, None, None, "7f_tearoom")),
        ("what is open", (None, None, None, None, None)),
        ("", (None, None, None, None, None)),
        (None, (None, None, None, None, None)),
    ],
)
def test_parse(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    got = r.parse(df, "text", PLACES).select("target_type", "color", "predicate", "anchor_type", "location").first()
    assert tuple(got) == want


def test_answers(spark):
    one = lambda f, *v: spark.createDataFrame([v], "a string, n int").select(f(F.col("a"), F.col("n"))).first()[0]
    cases = [("왼쪽거", 3, 0), ("2번", 3, 1), ("the last one", 4, 3), ("9", 3, None), ("middle", 1, None), ("", 3, None), (None, 3, None), ("2", 0, None), ("99999999999999999999", 3, None)]
    assert [one(r.position, a, n) for a, n, _ in cases] == [w for *_, w in cases]
    cases = [("2", 3, 1), ("the second one", 3, 1), ("neither", 3, -1), ("fourth", 3, None), ("7", 3, None), (None, 3, None)]
    assert [one(r.shortlist_pick, a, n) for a, n, _ in cases] == [w for *_, w in cases]
    every = lambda a: one(lambda c, _: r.wants_all(c), a, 0)
    assert [every(a) for a in ("List all bottles", "where is my ball", "有哪些包", None, "")] == [True, False, True, False, False]


def test_spoken_form(spark):
    long, no_end = "One sentence that goes on " * 6 + "to here. And then " + "more " * 40, "word " * 60
    df = spark.createDataFrame([("first\nsecond",), (long,), (no_end,), (None,), ("",)], "a string")
    got = [x[0] for x in df.select(r.spoken_form(F.col("a"))).collect()]
    assert got == ["first", long[: long.index("here.") + 5], no_end[:200].rstrip() + "...", "", ""]


def test_wake_word(spark):
    cases = [("헤이 로파, 내 가방 어딨어?", True, "내 가방 어딨어?"), ("hey, LOPA!", True, ""), ("where did they go", False, ""), ("“Hello, are you there", True, "are you there"), ("", False, ""), (None, False, "")]
    df = spark.createDataFrame([(a,) for a, *_ in cases], "a string")
    got = [tuple(x) for x in df.select(r.wake_word(F.col("a"), ["heylopa", "헤이로파"]).alias("w")).select("w.*").collect()]
    assert got == [tuple(c[1:]) for c in cases]


def test_replies(spark):
    df = spark.createDataFrame([("마우스", "left_of"), ("펜", "on"), ("", None)], "a string, p string")
    got = [tuple(x) for x in df.select(r.particle(F.col("a"), "이", "가"), r.place_text(F.lit("office"), F.col("p"), F.lit("book"))).collect()]
    assert got == [("가", "in the office, left of the book in this photo"), ("이", "in the office, on top of the book"), ("가", "in the office")]


def test_a_text_is_parsed_once(spark):
    """However many rows say it, a text is understood once; a row stays a row, null texts too."""
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"find my {'red' if i % 2 else 'blue'} mug") for i in range(20)], "id int, text string")
    out = r.parse(df, "text", PLACES)
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x.id, x.text, x.target_type, x.color) for x in out.collect()) == [(i, None, None, None) if i % 5 == 0 else (i, f"find my {'red' if i % 2 else 'blue'} mug", "mug", "red" if i % 2 else "blue") for i in range(20)]
