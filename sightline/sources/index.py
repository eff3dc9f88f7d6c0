"""A written index of pictures that is built in commits and goes on where it stopped.

``resume`` reads the pictures that no commit holds yet, some at a time. A commit is four
tables (scenes, objects, relations, failures) in a folder of its own, valid once its entry
in the log is written; what a lost driver left without one is written over by the next
run. Of a scene that was read again the latest commit counts. A failed picture has no
scene, only a failure, so the next run tries it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indexing
from .scenes import IMAGES
from .scratch import cut

LOG = "commit long, created_at string, scenes long, objects long, failures long"
SCENES = "scene_id string, location string, path string, width int, height int, caption string"
OBJECTS = "scene_id string, ord int, type string, color string, material string, size string, conf double, box struct<x1:double,y1:double,x2:double,y2:double>"
RELATIONS = "scene_id string, rel_ord int, a int, predicate string, b int"
FAILURES = "scene_id string, path string, failure string"
TABLES = {"scenes": SCENES, "objects": OBJECTS, "relations": RELATIONS, "failures": FAILURES}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def log(spark: SparkSession, out: str) -> DataFrame:
    """LOG: a row a commit."""
    return spark.read.schema(LOG).parquet(f"{out}/log/*") if exists(spark, f"{out}/log") else spark.createDataFrame([], LOG)


def table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the index as all commits leave it, with the commit of each row."""
    numbers = sorted(r[0] for r in log(spark, out).select("commit").collect())  # a number a commit
    parts = [f"{out}/commits/{n}/{name}" for n in numbers]
    schema = f"{TABLES[name]}, commit long"
    rows = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    if not parts:
        return rows
    owner = "scenes" if name != "failures" else "failures"
    newest = spark.read.schema(f"{TABLES[owner]}, commit long").parquet(*[f"{out}/commits/{n}/{owner}" for n in numbers]).groupBy("scene_id").agg(F.max("commit").alias("commit"))
    rows = rows.join(newest, ["scene_id", "commit"], "left_semi")
    if name == "failures":  # what was read later on is no failure
        rows = rows.join(table(spark, out, "scenes").select("scene_id", F.col("commit").alias("c")), "scene_id", "left").where("c IS NULL OR c < commit").drop("c")
    return rows


def resume(pictures: DataFrame, out: str, make: Callable[[], indexing.Model], prompt: str, mode: str, at_once: int = 1000, grid: int = 0, samples: tuple = (), only: str | None = None, force: bool = False, limit: int | None = None) -> int:
    """Index pictures (scene_id, location, path, width, height) into ``out``; the number of commits made.

    ``only`` a location, the first ``limit`` by location and path. ``force`` reads again
    what is there already. About ``at_once`` pictures a commit, dealt by a hash of their
    id, each commit a few Spark jobs over its own pictures.
    """
    spark = pictures.sparkSession
    todo = pictures.where(F.col("location") == only) if only else pictures
    if limit is not None:
        todo = todo.orderBy("location", "path").limit(limit)
    if not force:
        todo = todo.join(table(spark, out, "scenes").select("scene_id"), "scene_id", "left_anti")
    todo = cut(todo.select("scene_id", "location", "path", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")), "pictures")
    parts = -(-todo.count() // at_once)
    last = log(spark, out).agg(F.max("commit")).first()[0]
    for k in range(parts):
        mine = todo.where(F.pmod(F.xxhash64("scene_id"), F.lit(parts)) == k)
        commit(mine, out, 0 if last is None else last + 1, make, prompt, mode, grid, samples)
        last = 0 if last is None else last + 1
    return parts


def commit(pictures: DataFrame, out: str, number: int, make, prompt: str, mode: str, grid: int, samples: tuple) -> None:
    spark = pictures.sparkSession
    rows = pictures.withColumnRenamed("scene_id", "scene").withColumn("seen_w", F.col("width")).withColumn("seen_h", F.col("height"))
    told = cut(indexing.described(indexing.passes_of(rows, grid), make, prompt), "described")  # the model runs once
    told = indexing.parsed(told).withColumn("failure", F.coalesce("failure", F.when(F.col("unread") & (F.col("pass_no") == 0), F.lit("no objects in the answer"))))
    wrong = told.where("pass_no = 0 AND failure IS NOT NULL").select(F.col("scene").alias("scene_id"), "path", "failure")
    good = told.join(wrong.select(F.col("scene_id").alias("scene")), "scene", "left_anti").where("raw IS NOT NULL")
    objs, edges = indexing.scenes_of(good.drop("answer", "miscounted", "unread", "failure"), mode, list(samples))
    objs = cut(objs, "found")
    edges = indexing.relations.edges(objs, (F.col("width"), F.col("height")))
    whole = good.where("pass_no = 0")
    tables = {
        "scenes": whole.select(F.col("scene").alias("scene_id"), "location", "path", "width", "height", F.col("answer.caption").alias("caption")),
        "objects": objs.select(F.col("scene").alias("scene_id"), "ord", "type", "color", "material", "size", "conf", "box"),
        "relations": edges.select(F.col("scene").alias("scene_id"), F.col("rel_ord").cast("int").alias("rel_ord"), F.col("a").cast("int").alias("a"), "predicate", F.col("b").cast("int").alias("b")),
        "failures": wrong,
    }
    for name, df in tables.items():
        df.withColumn("commit", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/commits/{number}/{name}")
    count = lambda name: F.lit(spark.read.parquet(f"{out}/commits/{number}/{name}").count()).cast("long").alias(name)
    spark.range(1).select(F.lit(number).cast("long").alias("commit"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created_at"), *[count(n) for n in ("scenes", "objects", "failures")]).coalesce(1).write.mode("overwrite").parquet(f"{out}/log/{number}")


def coverage(spark: SparkSession, out: str) -> DataFrame:
    """One row: photos, locations (in order), candidates (objects) and failures of the index as it stands."""
    whole, objs, failed = (table(spark, out, n) for n in ("scenes", "objects", "failures"))
    one = lambda df, *c: F.broadcast(df.agg(*c))
    told = one(whole, F.count("*").alias("photos"), F.array_sort(F.collect_set("location")).alias("locations")).join(one(objs, F.count("*").alias("candidates")))  # a name a location
    return told.join(one(failed, F.count("*").alias("failures")))


def nested(spark: SparkSession, out: str) -> DataFrame:
    """A row a scene, as ``scenes.load`` gives them: objects and relations in arrays."""
    ident = lambda ord_: F.concat(F.col("scene_id"), F.lit("_o"), (ord_ - 1).cast("string"))
    b = F.col("box")
    item = F.struct(F.col("ord"), F.struct(ident(F.col("ord")).alias("id"), "type", F.struct("color", "material", "size").alias("attributes"), F.array(b["x1"], b["y1"], b["x2"], b["y2"]).alias("bbox"), F.col("conf").alias("confidence")).alias("o"))
    objs = table(spark, out, "objects").groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["o"]).alias("objects"))  # one picture's
    edge = F.struct(F.col("rel_ord"), F.struct(ident(F.col("a")).alias("subject"), "predicate", ident(F.col("b")).alias("object")).alias("r"))
    rels = table(spark, out, "relations").groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(edge)), lambda x: x["r"]).alias("relations"))
    empty = lambda df, name: F.coalesce(name, F.array().cast(df.schema[name].dataType))
    rows = table(spark, out, "scenes").join(objs, "scene_id", "left").join(rels, "scene_id", "left")
    return rows.select("scene_id", "location", F.col("path").alias("image_path"), "width", "height", "caption", empty(objs, "objects").alias("objects"), empty(rels, "relations").alias("relations"))


def unindexed(spark: SparkSession, root: str, scenes: DataFrame) -> DataFrame | None:
    """Pictures below ``root`` (path relative to it) that no scene's image_path names; None, not an empty table, where there is no such folder.

    An image_path counts from two folders above ``root``, or is a whole path.
    """
    if not exists(spark, root):
        return None
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at)
    base = lambda p: F.regexp_replace(p, r"^[a-z]+:/+", "/")  # noqa: E731  with or without a scheme
    here = full.toUri().getPath().rstrip("/")
    project = here.rpartition("/")[0].rpartition("/")[0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(base(F.col("path")).alias("p")).where(F.col("p").rlike(IMAGES.replace("|webp|heic", "")))
    known = scenes.where("image_path IS NOT NULL").select(F.when(F.startswith("image_path", F.lit("/")) | F.col("image_path").rlike("^[a-z]+:/"), base(F.col("image_path"))).otherwise(F.concat(F.lit(project + "/"), F.col("image_path"))).alias("p"))
    return files.join(known, "p", "left_anti").select(F.substr("p", F.lit(len(here) + 2)).alias("path"))
