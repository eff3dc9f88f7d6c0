"""From pictures to scenes: the model's calls, its answers as detections, detections as objects, objects as scenes.

Pictures, frames and tiles are rows; a model is any function from pictures to texts.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import jsonx
from ..functions.text import COLOR_ALIASES, OBJECT_WORDS, contained, mapped
from . import cleanup, relations

#: A model: texts for pictures (path, prompt), as many as it was given.
Model = Callable[[list[tuple[str, str]]], list[str]]


def dummy(items: list[tuple[str, str]]) -> list[str]:
    """A model without a model: one object, named after the picture."""
    return ['{"n_objects": 1, "objects": [{"type": "%s", "color": "black", "bbox": [100, 100, 500, 500], "confidence": 0.9}], "caption": "a picture"}' % path.rpartition("/")[2].partition(".")[0] for path, _ in items]


MODELS: dict[str, Callable[[], Model]] = {"dummy": lambda: dummy}


def load_model(name: str) -> Callable[[], Model]:
    """How a model is made, once in every worker; unknown names raise."""
    if name not in MODELS:
        raise ValueError(f"no such model: {name}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name]


def described(pictures: DataFrame, make: Callable[[], Model], prompt: str, size: int = 4) -> DataFrame:
    """Adds raw (the model's text) and failure (its error) to pictures (path, ...). Batches of ``size``; of a batch that fails each picture is tried alone."""
    names = pictures.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pictures.schema) + ", raw string, failure string"

    def run(batches):
        model = make()
        for batch in batches:
            paths, raws, failures = batch.column(names.index("path")).to_pylist(), [], []
            for k in range(0, len(paths), size):
                items = [(p, prompt) for p in paths[k : k + size]]
                try:
                    got = [(t, None) for t in model(items)]
                    if len(got) != len(items):
                        raise ValueError("not a text a picture")
                except Exception:  # noqa: BLE001  whatever a model raises, the others of the batch must not be lost
                    got = []
                    for item in items:
                        try:
                            got.append((model([item])[0], None))
                        except Exception as e:  # noqa: BLE001
                            got.append((None, f"{type(e).__name__}: {e}"))
                raws += [t for t, _ in got]
                failures += [f for _, f in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raws, pa.string()), pa.array(failures, pa.string())], names=[*names, "raw", "failure"])

    return pictures.mapInArrow(run, kind)


def parsed(passes: DataFrame) -> DataFrame:
    """Adds answer (jsonx.LOOSE), miscounted and unread to passes with ``raw``, which stays."""
    out = jsonx.with_answer(passes, "raw", "answer")
    return out.withColumn("miscounted", jsonx.miscounted(F.col("answer"))).withColumn("unread", F.col("answer.objects").isNull())


def _clean(value: Column) -> Column:
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


def detections(passes: DataFrame, mode: str, samples: list[tuple[int, int, int, int]] = (), slack: float = 2) -> DataFrame:
    """A row a usable object of every parsed pass (scene, pass_no, width, height, seen_w, seen_h, tile): ord, type, attributes, conf, box in the picture's pixels, rel_size in its own frame.

    A frame is the picture or its tile (struct x0, y0, x1, y1); width and height are the
    picture's, seen_w and seen_h those of the image that the model got. Boxes need four
    numbers, two pixels at least, and to be other than the prompt's own samples, which
    are compared in the model's coordinates. Objects cut by a tile's inner edge go.
    """
    tile = F.coalesce("tile", F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").cast("int").alias("x1"), F.col("height").cast("int").alias("y1")))
    rows = passes.withColumn("tile", tile).select("scene", "pass_no", "width", "height", "seen_w", "seen_h", "tile", F.posexplode("answer.objects").alias("at", "o"))
    b = F.col("o.bbox")
    rows = rows.where((F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x)))
    asked = F.struct(*[F.round(F.get(b, F.lit(i))).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    rows = rows.where(~cleanup.is_echo(asked, list(samples), slack)) if samples else rows
    frame = {"x": F.col("tile.x1") - F.col("tile.x0"), "y": F.col("tile.y1") - F.col("tile.y0")}
    at = lambda i, axis, seen: cleanup.to_pixels(F.get(b, F.lit(i)), F.lit(mode), F.col(seen), frame[axis]) + F.col(f"tile.{axis}0")
    rows = rows.withColumn("box", g.box(at(0, "x", "seen_w"), at(1, "y", "seen_h"), at(2, "x", "seen_w"), at(3, "y", "seen_h")))
    rows = rows.where((g.width(F.col("box")) >= 2) & (g.height(F.col("box")) >= 2) & ~cleanup.truncated(F.col("box"), F.col("tile"), F.col("width"), F.col("height")))
    size = F.coalesce(F.try_divide(g.area(F.col("box")), F.nullif((frame["x"] * frame["y"]).cast("double"), F.lit(0.0))), F.lit(0.0))
    kind = F.coalesce(contained(_clean(F.col("o.type")), OBJECT_WORDS), F.lit("unknown"))
    color = mapped(_clean(F.col("o.color")), COLOR_ALIASES)
    sure = F.coalesce(F.nullif(F.col("o.confidence"), F.lit(0.0)), F.lit(0.5))
    return rows.select("scene", "pass_no", ((F.col("pass_no") + 1) * 1000 + F.col("at")).cast("int").alias("ord"), kind.alias("type"), F.when(_clean(F.col("o.color")).isNotNull(), color).alias("color"), _clean(F.col("o.material")).alias("material"), _clean(F.col("o.size")).alias("size"), sure.alias("conf"), "box", size.alias("rel_size"), "width", "height")


def finished(found: DataFrame) -> DataFrame:
    """Detections of one frame or merged passes as objects: what can be carried, no patterns, no object twice; ord counts from 1 again, by place."""
    own = found.where(cleanup.portable(F.col("type"))).withColumn("frame", F.col("width") * F.col("height"))
    patterns = cleanup.patterns(own)
    own = own.join(patterns.select("scene", "type"), ["scene", "type"], "left_anti")
    kept = cleanup.deduplicate(own)
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("scene").orderBy("ord")).cast("int"))


def merged_passes(found: DataFrame) -> DataFrame:
    """Detections of the whole frame and of its tiles, each object once, as detections."""
    kept = cleanup.merge_passes(found).select("scene", "ord")
    return found.join(kept, ["scene", "ord"], "left_semi")


def scenes_of(passes: DataFrame, mode: str, samples: list[tuple[int, int, int, int]] = ()) -> tuple[DataFrame, DataFrame]:
    """Objects and relations of described passes, tiled pictures' passes merged first."""
    found = detections(parsed(passes.where("raw is not null")), mode, samples)
    objs = finished(merged_passes(found))
    return objs, relations.edges(objs, (F.col("width"), F.col("height")))


def passes_of(pictures: DataFrame, grid: int = 0) -> DataFrame:
    """Pictures (scene, path, width, height) as passes: the whole frame, and its tiles for a grid of two or more."""
    whole = pictures.withColumn("pass_no", F.lit(0)).withColumn("tile", F.lit(None).cast("struct<x0:int,y0:int,x1:int,y1:int>"))
    if grid < 2:
        return whole
    tiled = pictures.select("*", F.posexplode(cleanup.tiles(F.col("width"), F.col("height"), grid)).alias("k", "tile")).withColumn("pass_no", F.col("k") + 1).drop("k")
    return whole.unionByName(tiled)


def build(known: DataFrame, pictures: DataFrame, force: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scenes that stay and pictures to be read: all known scenes stay, but those that are read again.

    Without ``force`` only pictures without a scene are read. ``limit`` takes the first
    by location and path; scenes outside the selection are kept.
    """
    todo = pictures if force else pictures.join(known.select("scene_id"), "scene_id", "left_anti")
    if limit is not None:
        todo = todo.orderBy("location", "path").limit(limit)
    return known.join(todo.select("scene_id"), "scene_id", "left_anti"), todo
