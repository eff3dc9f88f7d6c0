"""Spatial joins within a scene: pairs, nearest neighbours, relation semi-joins and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.once import once


def pairs(objs: DataFrame) -> DataFrame:
    """Ordered pairs of a scene's objects (scene, ord, box and type of each): an equi-join, as large as scenes are dense."""
    a = objs.select("scene", F.col("ord").alias("a"), F.col("type").alias("a_type"), F.col("box").alias("a_box"))
    b = objs.select("scene", F.col("ord").alias("b"), F.col("type").alias("b_type"), F.col("box").alias("b_box"))
    return a.join(b, "scene").where("a <> b")


def neighbours(objs: DataFrame, k: int = g.NEIGHBOURS) -> DataFrame:
    """Each object's k nearest, ties in input order."""
    rank = Window.partitionBy("scene", "a").orderBy("dist", "b")
    return pairs(objs).withColumn("dist", g.distance(F.col("a_box"), F.col("b_box"))).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


@once
def _flags(w, h) -> list[Column]:
    """A column a relation, in the order in which they are told; computed in one projection, so each measure once."""
    a, b = F.col("a_box"), F.col("b_box")
    holds = {p: F.coalesce(g.predicate(p, a, b), F.lit(False)) for p in g.BINARY}
    holds["near"] = F.coalesce(g.near(a, b, w, h), F.lit(False))
    return [c.alias(f"_{p}") for p, c in holds.items()]


@once
def _told() -> Column:
    """A row a relation: its place in the order, its name, whether it holds; ``near`` only where nothing closer does."""
    closer = F.col("_on") | F.col("_inside") | F.col("_beside")
    holds = [*(F.col(f"_{p}") for p in g.BINARY), F.col("_near") & ~closer]
    return F.stack(F.lit(len(holds)), *[x for i, c in enumerate(holds) for x in (F.lit(i), F.lit((*g.BINARY, "near")[i]), c)]).alias("p", "predicate", "holds")


def edges(objs: DataFrame, frame=(1000, 800), k: int = g.NEIGHBOURS) -> DataFrame:
    """scene, a, predicate, b, types and rel_ord: the stored relations."""
    near = neighbours(objs, k)
    if isinstance(frame[0], Column):  # each scene has its own
        sizes = objs.groupBy("scene").agg(F.max(frame[0]).alias("w"), F.max(frame[1]).alias("h"))
        flags = _flags.__wrapped__(F.col("w"), F.col("h"))
        near = near.join(sizes, "scene")
    else:
        flags = _flags(*frame)
    own = ["scene", "a", "b", "a_type", "b_type", "rank"]
    found = near.select(*own, *flags).select(*own, _told()).where("holds").drop("holds")
    return found.withColumn("rel_ord", F.row_number().over(Window.partitionBy("scene").orderBy("a", "rank", "p")))


def related(objs: DataFrame, edge: DataFrame, wanted: str, anchor: str, negated: bool = False) -> DataFrame:
    """Objects with (or without) a relation that serves ``wanted`` to an object of the anchor's type."""
    hits = edge.where(F.col("predicate").isin(*g.WIDENED.get(wanted, (wanted,))) & (F.col("b_type") == anchor)).select("scene", F.col("a").alias("ord"))
    return objs.join(hits, ["scene", "ord"], "left_anti" if negated else "left_semi")


def best_anchor(edge: DataFrame, order: list[str]) -> DataFrame:
    """Each subject's anchor of another type: first by the relations' order, then by emission."""
    ranked = edge.withColumn("prio", F.array_position(F.array(*map(F.lit, order)), F.col("predicate"))).where("prio > 0 and a_type <> b_type")
    first = F.row_number().over(Window.partitionBy("scene", "a").orderBy("prio", "rank", "p"))  # of one subject, as rel_ord
    return ranked.withColumn("n", first).where("n = 1").select("scene", "a", "predicate", F.col("b_type").alias("anchor"))
