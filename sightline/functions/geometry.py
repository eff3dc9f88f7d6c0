"""Boxes as Columns: struct<x1,y1,x2,y2 double>, corners in order, and the predicates between two of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the relation rules
NEAR_DIAGONAL, BESIDE_GAP, ALIGNED, ON_GAP, SAME_BOX, OVERLAPS, SURFACE = 0.22, 0.80, 0.25, 0.15, 0.70, 0.08, 0.10
NEIGHBOURS = 4
BINARY = ("beside", "left_of", "right_of", "above", "below", "on", "inside", "overlapping", "same_surface")
IMPLY_NEAR = ("on", "inside", "beside")
#: What a stored relation may be to serve a request for the key; positions in the picture alone never do.
WIDENED = {
    "beside": ("beside", "near"), "near": ("near", "beside"), "left_of": ("beside", "near"), "right_of": ("beside", "near"),
    "above": ("on", "above", "near"), "below": ("below", "near"), "on": ("on", "above"), "inside": ("inside",),
    "overlapping": ("overlapping", "inside"), "same_surface": ("same_surface", "beside", "near"),
}


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    d = lambda c: c.cast("double")
    return F.struct(d(F.least(x1, x2)).alias("x1"), d(F.least(y1, y2)).alias("y1"), d(F.greatest(x1, x2)).alias("x2"), d(F.greatest(y1, y2)).alias("y2"))


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def _overlap(a: Column, b: Column, axis: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[f"{axis}2"], b[f"{axis}2"]) - F.greatest(a[f"{axis}1"], b[f"{axis}1"]))


def aligned(a: Column, b: Column, axis: str) -> Column:
    """Overlap on an axis as a share of the shorter side; 0 for a side of no length."""
    side = width if axis == "x" else height
    return F.coalesce(F.try_divide(_overlap(a, b, axis), F.nullif(F.least(side(a), side(b)), F.lit(0.0))), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    return _overlap(a, b, "x") * _overlap(a, b, "y")


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.coalesce(F.try_divide(both, F.nullif(union, F.lit(0.0))), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def near(a: Column, b: Column, frame_w, frame_h) -> Column:
    w, h = (F.lit(x).cast("double") if not isinstance(x, Column) else x.cast("double") for x in (frame_w, frame_h))
    return distance(a, b) < NEAR_DIAGONAL * F.sqrt(w * w + h * h)


def predicate(name: str, a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    level, stacked = aligned(a, b, "y") >= ALIGNED, aligned(a, b, "x") >= ALIGNED
    if name == "beside":
        gap, mean = F.greatest(F.lit(0.0), F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"])), (width(a) + width(b)) / 2
        return level & (mean > 0) & (gap < BESIDE_GAP * mean)
    if name in ("left_of", "right_of"):
        return level & ((ax < bx) if name == "left_of" else (ax > bx))
    if name in ("above", "below"):
        return stacked & ((ay < by) if name == "above" else (ay > by))
    if name == "on":
        gap = b["y1"] - a["y2"]
        return stacked & (gap >= -0.1 * height(a)) & (gap <= ON_GAP * F.greatest(height(b), F.lit(1.0)))
    if name == "inside":
        return (area(a) > 0) & (F.coalesce(F.try_divide(intersection(a, b), F.nullif(area(a), F.lit(0.0))), F.lit(0.0)) > 0.8) & (area(b) > area(a))
    if name == "overlapping":
        share = iou(a, b)
        return (share > 0) & (share < SAME_BOX) & ((share >= OVERLAPS) | ((aligned(a, b, "x") >= 0.35) & (aligned(a, b, "y") >= 0.35)))
    if name == "same_surface":
        room = SURFACE * F.greatest(height(a), height(b), F.lit(1.0))
        return (area(a) > 0) & (area(b) > 0) & (F.abs(a["y2"] - b["y2"]) <= room) & (aligned(a, b, "y") >= 0.15)
    raise ValueError(f"no such relation: {name}")


def relations(a: Column, b: Column, frame_w, frame_h) -> Column:
    """All relations of a to b, ``near`` only where nothing closer is said."""
    found = F.array_compact(F.array(*[F.when(predicate(p, a, b), F.lit(p)) for p in BINARY]))
    closer = F.arrays_overlap(found, F.array(*map(F.lit, IMPLY_NEAR)))
    return F.when(near(a, b, frame_w, frame_h) & ~F.coalesce(closer, F.lit(False)), F.concat(found, F.array(F.lit("near")))).otherwise(found)
