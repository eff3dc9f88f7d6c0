"""Detections into objects: conversion, filters, ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

# fixed values
FIXTURES = (
    "sink", "faucet", "tap", "water cooler", "ice maker", "fridge", "refrigerator", "microwave", "kettle", "plant", "pot plant", "radiator", "air conditioner", "lamp", "light", "clock", "mirror",
    "painting", "picture", "curtain", "blind", "door", "window", "wall", "floor", "ceiling", "desk", "table", "chair", "sofa", "shelf", "cabinet", "drawer", "monitor", "screen", "printer", "television", "tv",
    "hair dryer", "hairdryer", "towel", "soap", "tissue", "bin", "trash can",
)
EDGE, MERGE_IOU, OVERLAP = 0.02, 0.45, 0.30


def portable(kind: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(kind, F.lit("")))).isin(*FIXTURES)


def to_pixels(v: Column, mode: Column, resized: Column, original: Column) -> Column:
    """A coordinate in the picture's own pixels, one decimal; an unknown mode raises."""
    scaled = F.when(mode == "norm1000", v / 1000.0 * original).when(mode == "abs_resized", v * F.try_divide(original.cast("double"), resized.cast("double"))).otherwise(F.raise_error(F.concat(F.lit("unknown coordinate mode: "), mode)).cast("double"))
    return F.round(F.least(original.cast("double"), F.greatest(F.lit(0.0), scaled)), 1)


def is_echo(b: Column, samples: list[tuple[int, int, int, int]], slack: float = 2) -> Column:
    """A box that repeats one of the prompt's own, in the same coordinates."""
    hit = F.lit(False)
    for sample in samples:
        one = F.lit(True)
        for c, v in zip(("x1", "y1", "x2", "y2"), sample, strict=True):
            one = one & (F.abs(b[c] - v) <= slack)
        hit = hit | one
    return hit


def truncated(b: Column, tile: Column, w: Column, h: Column) -> Column:
    """Within 2 % of a tile's edge that isn't the picture's."""
    mx, my = EDGE * (tile["x1"] - tile["x0"]), EDGE * (tile["y1"] - tile["y0"])
    return ((tile["x0"] > 0) & (b["x1"] <= tile["x0"] + mx)) | ((tile["y0"] > 0) & (b["y1"] <= tile["y0"] + my)) | ((tile["x1"] < w) & (b["x2"] >= tile["x1"] - mx)) | ((tile["y1"] < h) & (b["y2"] >= tile["y1"] - my))


def tiles(w: Column, h: Column, grid: int, overlap: float = OVERLAP) -> Column:
    """Array of tiles struct<x0,y0,x1,y1>, rows first; a grid below 2 has none."""
    if grid < 2:
        return F.array().cast("array<struct<x0:int,y0:int,x1:int,y1:int>>")
    side = lambda n: n / (grid - (grid - 1) * overlap)
    tw, th = side(w), side(h)
    at = lambda k, t, n: (F.greatest(F.lit(0), F.round(k * t * (1 - overlap)).cast("int")), F.least(n.cast("int"), F.round(k * t * (1 - overlap) + t).cast("int")))

    def one(i: Column) -> Column:
        (x0, x1), (y0, y1) = at(i % grid, tw, w), at(F.floor(i / grid), th, h)
        return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    return F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), one)


def _fold(rows: DataFrame, keys: list[str], order: Column, cols: list[str], step) -> DataFrame:
    """An ordered fold over each group's rows, in the JVM; groups are scenes, so small."""
    item = F.struct(order.alias("k"), *cols)
    kind = rows.select(F.array(item).alias("x")).schema["x"].dataType
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    kept = F.aggregate("all", F.array().cast(kind), step)
    return held.select(*keys, F.explode(kept).alias("o")).select(*keys, *[F.col(f"o.{c}").alias(c) for c in cols])


def merge_passes(found: DataFrame, least: float = MERGE_IOU) -> DataFrame:
    """Of detections (scene, ord, type, box, rel_size) of all passes: largest in their own frame first, each kept unless one of its type lies there."""
    step = lambda kept, x: F.when(F.exists(kept, lambda y: (y["type"] == x["type"]) & (g.iou(y["box"], x["box"]) >= least)), kept).otherwise(F.array_append(kept, x))
    return _fold(found, ["scene"], F.struct((-F.col("rel_size")).alias("s"), F.col("ord").alias("o")), ["ord", "type", "box", "rel_size"], step)


def deduplicate(objs: DataFrame, least: float = g.SAME_BOX, keys: tuple[str, ...] = ("scene",)) -> DataFrame:
    """Boxes that are one object keep the first one's place (ord) and the surest one's other columns."""
    rest = [c for c in objs.columns if c not in (*keys, "ord")]

    def step(kept: Column, x: Column) -> Column:
        same = F.filter(F.transform(kept, lambda y, i: F.struct(g.iou(y["box"], x["box"]).alias("u"), i.alias("i"))), lambda s: s["u"] >= least)
        at = same[0]["i"]
        better = F.transform(kept, lambda y, i: F.when((i == at) & (x["conf"] > y["conf"]), F.struct(y["k"].alias("k"), y["ord"].alias("ord"), *[x[c].alias(c) for c in rest])).otherwise(y))
        return F.when(F.size(same) == 0, F.array_append(kept, x)).otherwise(better)

    return _fold(objs, list(keys), F.col("ord"), ["ord", *rest], step)


def textures(objs: DataFrame, keys: list[str], least: int = 6, spread: float = 0.35, hull: float = 0.45, frame=(1000, 800)) -> DataFrame:
    """Groups that look like a pattern, not objects: many of a type, alike in size, close together. Sums alone; ``gathered`` adds what ``bands`` needs."""
    b = F.col("box")
    # n * sum of squares - square of the sum: whole pixels give the same in any order, also where a group lies right on the limit
    off = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.count(c) * F.sum(c * c) - F.sum(c) * F.sum(c)))
    cv = lambda c: F.coalesce(F.try_divide(off(c), F.nullif(F.sum(c), F.lit(0.0))), F.lit(1.0))
    area = frame[0] * frame[1] if isinstance(frame, tuple) else frame
    area = F.max(area).cast("double") if isinstance(area, Column) else F.lit(float(area))
    size = F.try_divide((F.max(b["x2"]) - F.min(b["x1"])) * (F.max(b["y2"]) - F.min(b["y1"])), F.nullif(area, F.lit(0.0)))
    stats = objs.groupBy(*keys).agg(F.count("*").alias("n"), cv(g.width(b)).alias("cv_w"), cv(g.height(b)).alias("cv_h"), F.coalesce(size, F.lit(0.0)).alias("hull"))
    return stats.where((F.col("n") >= least) & (F.col("cv_w") <= spread) & (F.col("cv_h") <= spread) & (F.col("hull") <= hull))


def gathered(groups: DataFrame, objs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ys (sorted centres) and hs (sorted heights) of the objects of the groups that are left."""
    b = F.col("box")
    held = objs.join(groups.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list((b["y1"] + b["y2"]) / 2)).alias("ys"), F.sort_array(F.collect_list(g.height(b))).alias("hs"))
    return groups.join(held, keys)


def patterns(objs: DataFrame) -> DataFrame:
    """scene, type of objects that are a texture: alike, together, and in rows (three to a row at least). Needs frame, the picture's area."""
    keys = ["scene", "type"]
    some = gathered(textures(objs, keys, frame=F.col("frame")), objs, keys)
    return some.where(bands(F.col("ys"), F.col("hs")) * 3 <= F.col("n")).select(*keys)


def bands(ys: Column, heights: Column) -> Column:
    """Rows of a grid: a sorted centre opens one when it's further from the last row's first centre than 0.6 of the upper median height."""
    room = F.greatest(F.lit(1.0), 0.6 * F.element_at(heights, (F.floor(F.size(heights) / 2) + 1).cast("int")))
    return F.size(F.aggregate(ys, F.array().cast("array<double>"), lambda kept, y: F.when((F.size(kept) > 0) & (y - F.element_at(kept, -1) <= room), kept).otherwise(F.array_append(kept, y))))
