"""What keeps a task's work the same, whatever the input's size."""

import re

import pytest
from pyspark.sql import functions as F

from sightline.operators import evaluate, relations, retrieve, search
from sightline.plans import queries
from sightline.sources import scenes
from sightline.streaming import dialogue

from .test_dialogue import objs, understood  # noqa: F401  a fixture

SF = "/root/testdata/sf0.001"
KEPT = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.fixture
def small_tasks(spark, monkeypatch):
    """Tasks of a thousand lines; too many parts to be sent around."""
    monkeypatch.setattr(scenes, "ROWS", 1000)
    monkeypatch.setattr(scenes, "MANY", 10)
    yield
    for name in KEPT:
        spark.conf.unset(name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_lines(spark, small_tasks):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    tasks = -(-lines // 1000)
    assert "hashpartitioning(l_orderkey#" in plan(scenes.of_orders(spark, SF)) and f", {tasks}), REPARTITION_BY_NUM" in plan(scenes.of_orders(spark, SF))
    assert scenes.tasks_for(spark.range(2001), 1000) == 3 and scenes.tasks_for(spark.range(0), 1000) == 1


def test_a_task_holds_its_share(spark, small_tasks):
    """The lines themselves are dealt evenly, not just the partitions counted."""
    held = [r.n for r in scenes.of_orders(spark, SF).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == spark.read.parquet(f"{SF}/lineitem.parquet").count() and max(held) < 1500


@pytest.mark.parametrize("name", ["relation_semi", "renumbered", "described_targets", "scene_objects", "merged_counts", "pair_relations", "knn_pairs", "reference_view", "vote_majority"])
def test_no_shuffle_of_a_query_is_dealt_wider(spark, small_tasks, name):
    """What follows the scenes is dealt to as many tasks as they are, however few partitions the session has."""
    tasks = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1000)
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(.*, (\d+)\),", plan(queries.QUERIES[name](spark, SF)))]
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) and dealt and min(dealt) >= tasks


def test_rows_meet_their_names_where_they_are(spark):
    """Two names must not make two tasks of all rows."""
    rows = spark.range(2_000_000).select("id", F.when(F.col("id") % 2 == 0, "cup").otherwise("laptop").alias("type"))
    told = evaluate.with_canonical(rows, "type", "c")
    assert "BroadcastHashJoin" in plan(told) and "SortMergeJoin" not in plan(told)
    assert sorted(r["count"] for r in told.groupBy("type", "c").count().collect()) == [1_000_000, 1_000_000]


def test_order_scenes_are_the_same_however_dealt(spark, monkeypatch):
    told = lambda: sorted(tuple(r) for r in scenes.of_orders(spark, SF).select("scene", "place", "ord", "color", "type", "material", "size", "conf", "box.*").collect())
    whole = told()
    monkeypatch.setattr(scenes, "ROWS", 1000)
    monkeypatch.setattr(scenes, "MANY", 10)
    assert told() == whole
    for name in KEPT:
        spark.conf.unset(name)


def test_relations_are_compiled(spark):
    """No function over arrays walks the predicates row by row; each scene's own frame gives the same as a fixed one."""
    objs = scenes.of_orders(spark, SF)
    got = relations.edges(objs)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    own = relations.edges(objs.withColumn("w", F.lit(1000)).withColumn("h", F.lit(800)), (F.col("w"), F.col("h")))
    key = ["scene", "a", "rel_ord", "predicate", "b"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, own.select(key).collect()))


def test_requests_that_differ_in_constraints_share_their_views(spark, objs, monkeypatch):  # noqa: F811
    """A conversation asks again without each constraint: its views are ranked and folded once, with the same results."""
    folded, merge = [], retrieve.merge_views
    monkeypatch.setattr(retrieve, "merge_views", lambda rows, *a: folded.append(rows.count()) or merge(rows, *a))
    black, near = ("color", "black", False), ("near", "laptop", False)
    asks = {"a|0": [black, near], "a|1": [black], "a|2": [near], "a|3": [("color", "black", True)]}
    told = lambda some: sorted(map(str, search.find_candidates(spark.createDataFrame([(k, "base", "bottle", None, None, None, None, asks[k], i % 2, 5) for i, k in enumerate(asks) if k in some], search.REQUEST), objs).collect()))
    alone = [told([k]) for k in asks]
    assert told(asks) == sorted(r for rows in alone for r in rows) and len({len(rows) for rows in alone}) > 1
    assert folded == [folded[0]] * 5


def test_rounds_share_their_scenes(spark, objs, monkeypatch):  # noqa: F811
    """All objects are grouped into scenes once, however many turns there are."""
    made, make = [], search.scenes_of
    monkeypatch.setattr(search, "scenes_of", lambda rows: made.append(1) or make(rows))
    turns = understood(spark, [("c", i, "base", t) for i, t in enumerate(["where is my bottle", "black", "the office"], 1)])
    assert [r.kind for r in dialogue.replay(turns, objs).orderBy("turn").collect()] == ["question", "question", "answer"]
    assert len(made) == 1


def test_cases_share_their_scenes(spark, objs, monkeypatch):  # noqa: F811
    """A case that takes two answers groups the objects into scenes once."""
    made, make = [], search.scenes_of
    monkeypatch.setattr(search, "scenes_of", lambda rows: made.append(1) or make(rows))
    kind = "id string, collection string, query string, difficulty string, expect struct<location:string,type:string,color:string>, answers array<string>, known_gap boolean"
    case = ("c", "base", "where is my bottle", "ambiguous", ("office", "bottle", "black"), ["black", "the office"], False)
    [r] = evaluate.play(spark.createDataFrame([case], kind), objs, {"office": [], "classroom": [], "lounge": []}).collect()
    assert (r.asked, r.kind, r.ok, r.found) == (2, "answer", True, "office_01_o1")
    assert len(made) == 1


def test_rounds_fold_views_once(spark, objs, monkeypatch):  # noqa: F811
    """What is learned leaves the views as they are: they are folded in the first turn alone, and again for a turn that changes what they must be."""
    made, merge = [], retrieve.merge_views
    monkeypatch.setattr(retrieve, "merge_views", lambda *a: made.append(1) or merge(*a))
    turns = understood(spark, [("c", i, "base", t) for i, t in enumerate(["where is my bottle", "black", "the office"], 1)])
    assert [r.kind for r in dialogue.replay(turns, objs).orderBy("turn").collect()] == ["question", "question", "answer"]
    assert len(made) == 1
    known, ask = search.Entities(), [("a", "bottle", None), ("b", "bottle", "black"), ("a", "bottle", "black"), ("c", "bottle", None)]
    rounds = [[(rid, "base", target, None, None, None, None, [("color", color, False)] if color else [], 0, top) for rid, target, color in some] for top, some in ((5, ask[:2]), (5, ask[2:]), (None, ask[3:]))]
    rounds = [spark.createDataFrame(r, search.REQUEST) for r in rounds]
    made.clear()
    told = [sorted(map(str, search.find_candidates(r, objs, known=known).collect())) for r in rounds]
    assert len(made) == 2 and all(told)
    assert told == [sorted(map(str, search.find_candidates(r, objs).collect())) for r in rounds]
