"""Requests against scenes: ranked scenes, candidates, merged entities, constraints, order. Any number of requests in one plan.

Scenes belong to a collection (one person's pictures, one building); a request searches
its own. Objects come as rows (collection, scene, scene_ord, place, caption, ord, type,
color, material, size, conf, box) with their relations (``with_relations``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.once import once
from ..functions.requests import OBJECTS
from ..functions.text import LOOK_ALIKE
from ..sources.scratch import cut
from . import retrieve

#: Relations that hold from any side, most telling first, and those of one picture.
SAFE = ("on", "inside", "beside", "overlapping", "same_surface", "near")
PICTURED = ("left_of", "right_of", "above", "below")
RELS = "array<struct<rel_ord:int,predicate:string,anchor:string>>"
WANTED = "array<struct<key:string,value:string,negated:boolean>>"
REQUEST = f"rid string, collection string, target string, color string, predicate string, anchor string, location string, wanted {WANTED}, attributes int, top int"


def reach(synonyms: dict[str, list[str]] | None = None, groups=LOOK_ALIKE) -> dict[str, list[str]]:
    """What types of objects serve a wanted type: itself, look-alikes, types it is a synonym of, and laptops for a notebook."""
    synonyms = OBJECTS if synonyms is None else synonyms
    types = list(dict.fromkeys([*synonyms, *(t for names in groups for t in names)]))
    serves = lambda t, w: t == w or any(t in names and w in names for names in groups) or w in synonyms.get(t, []) or (w, t) == ("notebook", "laptop")
    return {w: [t for t in types if serves(t, w)] for w in types}


@once
def _map(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for w, ts in table.items() for x in (F.lit(w), F.array(*map(F.lit, ts)))])


def serves(kind: Column, wanted: Column, table: dict[str, list[str]]) -> Column:
    return (kind == wanted) | F.coalesce(F.array_contains(F.element_at(_map(table), wanted), kind), F.lit(False))


def with_relations(objs: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``rels``: an object's stored relations with their anchors' types, in order; at most four neighbours' worth."""
    own = edges.groupBy(F.col("scene"), F.col("a").alias("ord")).agg(F.array_sort(F.collect_list(F.struct(F.col("rel_ord").cast("int").alias("rel_ord"), "predicate", F.col("b_type").alias("anchor")))).alias("rels"))
    return objs.join(own, ["scene", "ord"], "left").withColumn("rels", F.coalesce("rels", F.array().cast(RELS)))


def anchor_of(rels: Column, kind: Column, order: tuple[str, ...], wanted: Column | None = None) -> Column:
    """struct(prio, rel_ord, predicate, anchor): the first relation by ``order`` to an object of another type (of type ``wanted``, if given); null without one."""
    place = F.array(*map(F.lit, order))
    fits = F.filter(rels, lambda r: (r["anchor"] != kind) & F.array_contains(place, r["predicate"]) & ((r["anchor"] == wanted) if wanted is not None else F.lit(True)))
    return F.array_min(F.transform(fits, lambda r: F.struct(F.array_position(place, r["predicate"]).alias("prio"), r["rel_ord"].alias("rel_ord"), r["predicate"].alias("predicate"), r["anchor"].alias("anchor"))))


def scenes_of(objs: DataFrame) -> DataFrame:
    """A row a scene: collection, scene, scene_ord, place, caption, types and looks (types with their colours). For many rounds over the same objects it is made once."""
    return objs.groupBy("collection", "scene").agg(F.min("scene_ord").alias("scene_ord"), F.min("place").alias("place"), F.lower(F.coalesce(F.min("caption"), F.lit(""))).alias("caption"), F.collect_set("type").alias("types"), F.collect_set(F.concat_ws("\n", "type", "color")).alias("looks"))  # what one scene holds


def ranked_scenes(requests: DataFrame, objs: DataFrame, table: dict[str, list[str]], scenes: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """rid, collection, scene, rank, score and ``carry`` of the request: a request's ``top`` best scenes that score at all (null: all of these); all scenes where none does."""
    scenes = scenes_of(objs) if scenes is None else scenes
    both = requests.join(scenes, "collection")
    holds = lambda w: F.coalesce(F.exists("types", lambda t: serves(t, F.col(w), table)), F.lit(False))
    points = lambda flag, n: F.when(F.coalesce(flag, F.lit(False)), n).otherwise(0.0)
    score = points(holds("target"), 3.0) + points(holds("anchor"), 2.0) + points(scenes["place"] == F.col("location"), 2.0) + points(F.col("color").isNotNull() & F.array_contains("looks", F.concat_ws("\n", "target", "color")), 1.5)
    score = score + points(F.contains("caption", F.col("target")), 0.5) + points(F.contains("caption", F.col("anchor")), 0.5)
    own = Window.partitionBy("rid")
    told = both.select("rid", "collection", "scene", "top", score.alias("score"), "scene_ord", *carry).withColumn("best", F.max("score").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.col("score").desc(), "scene_ord")))
    return told.where((F.col("best") <= 0) | ((F.col("score") > 0) & (F.col("top").isNull() | (F.col("rank") <= F.col("top"))))).select("rid", "collection", "scene", "rank", "score", *carry)


@once
def satisfied(table: dict[str, list[str]]) -> Column:
    """Whether an entity meets all that is wanted: any view's evidence serves, a rejection needs all views to agree, what was never seen doesn't serve."""
    seen = lambda key: F.array_distinct(F.transform(F.filter("seen", lambda x: x["k"] == key), lambda x: x["v"]))
    near = lambda v: F.exists("rels", lambda r: r["predicate"].isin(*SAFE) & (r["anchor"] != F.col("type")) & serves(r["anchor"], v, table))

    def meets(w: Column) -> Column:
        values = seen(w["key"])
        plain = F.when(w["negated"], ~((F.size(values) > 0) & F.forall(values, lambda v: v == w["value"]))).otherwise(F.array_contains(values, w["value"]))
        exact = lambda c: F.when(w["negated"], F.col(c) != w["value"]).otherwise(F.col(c) == w["value"])
        return F.when(w["value"].isNull(), True).when(w["key"] == "near", near(w["value"]) != w["negated"]).when(w["key"] == "type", exact("type")).when(w["key"] == "location", exact("place")).otherwise(plain)

    return F.forall(F.coalesce("wanted", F.array().cast(WANTED)), meets)


@once
def _places() -> tuple[Column, Column]:
    """The type of the neighbour to ask about, and the relation by which a place is told."""
    own, kind = F.col("rels"), F.col("type")
    return anchor_of(own, kind, SAFE)["anchor"], F.coalesce(anchor_of(own, kind, SAFE + PICTURED, F.col("anchor")), anchor_of(own, kind, SAFE + PICTURED))


#: What decides which views serve a request; constraints are asked of what these make.
BASE = ("collection", "target", "color", "predicate", "anchor", "location", "top")


def entities(bases: DataFrame, objs: DataFrame, table: dict[str, list[str]], groups, scenes: DataFrame | None = None) -> DataFrame:
    """What the views that serve each base (rid and BASE) make: a row an entity, with what a reply tells of it."""
    own = ("target", "predicate", "anchor")
    top = ranked_scenes(bases, objs, table, scenes, (*own, "location"))
    here = top.join(objs.withColumnRenamed("place", "at"), ["collection", "scene"])
    widened = F.element_at(_map({k: list(v) for k, v in g.WIDENED.items()}), F.col("predicate"))
    related = F.exists("rels", lambda r: F.array_contains(widened, r["predicate"]) & serves(r["anchor"], F.col("anchor"), table))
    here = here.where((F.col("location").isNull() | (F.col("at") == F.col("location"))) & (F.col("target").isNull() | serves(F.col("type"), F.col("target"), table)) & (F.col("predicate").isNull() | F.col("anchor").isNull() | F.coalesce(related, F.lit(False))))
    rows = here.select("rid", *own, F.col("at").alias("place"), retrieve.group_of(F.col("type"), groups).alias("grp"), "rank", "scene", "ord", "type", "color", "material", "size", "conf", "box", "rels")
    merged = retrieve.merge_views(rows, ("rid", *own, "place", "grp"), ("rank", "ord"), ("rels",))
    near, told = _places()
    colors = F.transform(F.filter("seen", lambda x: x["k"] == "color"), lambda x: x["v"])
    related = F.col("predicate").isNotNull() & F.col("anchor").isNotNull()
    kept = ("place", "entity", "type", "color", "material", "size", "scene", "ord", "g0", "g1", "views", "votes", "seen", "rels")
    return merged.select(F.col("rid").alias("base"), *kept, F.size(F.array_distinct("views")).alias("n_views"), related.alias("related"), F.col("type").eqNullSafe(F.col("target")).alias("exact"), colors.alias("colors"), near.alias("near"), told["predicate"].alias("predicate"), told["anchor"].alias("anchor"))


class Entities:
    """The entities of all bases that were asked for so far, in the shared folder. What is learned in a conversation seldom changes its base, so most rounds fold no views again."""

    def __init__(self):
        self.bases = self.rows = None

    def of(self, bases: DataFrame, make) -> DataFrame:
        new = cut(bases if self.bases is None else bases.join(self.bases, "rid", "left_anti"), "bases")
        if self.rows is None or not new.isEmpty():
            rows, new = cut(make(new), "entities"), new.select("rid")
            self.bases, self.rows = (new, rows) if self.rows is None else (self.bases.unionByName(new), self.rows.unionByName(rows))
        return self.rows


def find_candidates(requests: DataFrame, objs: DataFrame, synonyms: dict[str, list[str]] | None = None, groups=LOOK_ALIKE, scenes: DataFrame | None = None, known: Entities | None = None) -> DataFrame:
    """Entities that serve each request (REQUEST), best first: n from 1, score, band, place, scene, ord, type, color, material, size, views, seen, rels, colors (of any view), near (type of the neighbour to ask about), predicate and anchor (where it is told to be).

    Type, place and relation are asked of single views, constraints of merged entities.
    Requests that differ in constraints alone share their views. ``scenes`` is what
    ``scenes_of`` made of the objects, if it is at hand; ``known`` holds the entities of
    earlier requests against the same objects, and takes those of new ones.
    """
    table = reach(synonyms, groups)
    requests = requests.withColumn("base", F.md5(F.to_json(F.struct(*BASE)).cast("binary")))
    bases = requests.select(F.col("base").alias("rid"), *BASE).distinct()
    make = lambda some: entities(some, objs, table, groups, scenes)
    merged = make(bases) if known is None else known.of(bases, make)
    kept = merged.join(requests.select("rid", "base", "wanted", "attributes"), "base").where(satisfied(table))
    score = retrieve.candidate_score(F.col("votes"), F.col("n_views"), F.col("related"), F.col("attributes"), F.col("exact"))
    order = Window.partitionBy("rid").orderBy(F.col("score").desc(), "g0", "g1", "entity")
    out = kept.withColumn("score", score).withColumn("n", F.row_number().over(order))
    return out.select("rid", "n", "score", retrieve.band(F.col("score")).alias("band"), "place", "scene", "ord", "type", "color", "material", "size", "views", "seen", "rels", "colors", "near", "predicate", "anchor")


def as_seen(cands: DataFrame, by: list[str], shown: int = 6) -> DataFrame:
    """The first ``shown`` candidates (n, scene, x1) of a request with ``place``, their number as they stand in the picture: from left to right where all are of one, else by n."""
    own = Window.partitionBy(*by)
    first = cands.where(F.col("n") <= shown)
    one = F.size(F.collect_set("scene").over(own)) == 1
    return first.withColumn("_one", one).withColumn("place", F.row_number().over(own.orderBy(F.when(F.col("_one"), F.col("x1")), "n"))).drop("_one")


# ---------------------------------------------------------------- a second look

SURE = 0.6  # fixed value: a rejection below it isn't believed


def needs_look(score: Column, box: Column, w: Column, h: Column, least: float = 0.70, small: float = 0.018) -> Column:
    """Whether a candidate is worth a second look: a low score, or a small part of a picture of known size."""
    w, h = w.cast("double"), h.cast("double")
    share = F.try_divide(g.area(box), F.nullif(w * h, F.lit(0.0)))
    return (score < least) | F.coalesce((w > 0) & (h > 0) & (share < small), F.lit(False))


def crop(box: Column, w: Column, h: Column, margin: float = 0.35) -> Column:
    """The box with a margin on each side, in whole pixels within the picture; null where nothing is left."""
    dx, dy = margin * g.width(box), margin * g.height(box)
    x1, y1 = F.greatest(F.lit(0), F.floor(box["x1"] - dx).cast("int")), F.greatest(F.lit(0), F.floor(box["y1"] - dy).cast("int"))
    x2, y2 = F.least(w.cast("int"), F.floor(box["x2"] + dx).cast("int")), F.least(h.cast("int"), F.floor(box["y2"] + dy).cast("int"))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def kept_by_verdict(cands: DataFrame, by: list[str], sure: float = SURE) -> DataFrame:
    """Candidates (looked boolean, match boolean, confidence double) without those surely rejected; all of them where every one would go.

    Those not looked at come first, then the others, each in order of ``n``. A null
    verdict rejects nothing.
    """
    gone = F.coalesce(F.col("looked") & (F.col("match") == F.lit(False)) & (F.coalesce("confidence", F.lit(0.0)) >= sure), F.lit(False))
    own = Window.partitionBy(*by)
    told = cands.withColumn("gone", gone).withColumn("left", F.count_if(~F.col("gone")).over(own)).where(~F.col("gone") | (F.col("left") == 0))
    order = own.orderBy(F.when(F.col("left") == 0, False).otherwise(F.coalesce("looked", F.lit(False))), "n")
    return told.withColumn("n", F.row_number().over(order)).drop("gone", "left")


def fresh(cands: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that no look was spent on yet."""
    return cands.join(seen.select(*keys).distinct(), keys, "left_anti")
