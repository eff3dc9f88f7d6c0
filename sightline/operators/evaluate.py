"""Cases against scenes: which objects a described thing may be, a simulated owner, and the scorecard.

A case (id, collection, query, difficulty, expect, answers, known_gap) says what it looks
for by place, type and colour, never by an object's id; a null description means that
nothing is there to be found. All cases are played at once, a round of the conversation
at a time (``dialogue.round_of``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import requests
from ..functions.requests import OBJECTS
from ..functions.text import LOOK_ALIKE
from ..functions.words import OBJECTS_CJK
from ..sources.scratch import cut
from ..streaming import dialogue
from . import retrieve, search

#: Answers that an owner gives at most.
MOST = 10
UNKNOWN = "i don't know"


def in_scope(truth: DataFrame) -> DataFrame:
    """Labelled objects that are meant to be found."""
    return truth.where(F.col("scope") == "in")


def with_canonical(df: DataFrame, column: str, out: str, synonyms=None, cjk=OBJECTS_CJK) -> DataFrame:
    """Adds ``out``: the vocabulary's first name for a thing in words, else the words; ``{out}_known``: whether it has one. A name is looked up once, however many rows have it.

    Names are written apart, so Spark knows how few they are and sends them to the rows: shuffled by
    name, rows would meet in as many tasks as there are names.
    """
    names = df.select(F.col(column).alias("_name")).where("_name is not null").distinct()
    told = requests.with_types(names, "_name", "_types", synonyms or OBJECTS, cjk)
    told = told.select("_name", F.coalesce(F.get("_types", F.lit(0)), "_name").alias(out), (F.size("_types") > 0).alias("_known"))
    return df.join(cut(told, "names"), df[column] == F.col("_name"), "left").withColumn(f"{out}_known", F.coalesce("_known", F.lit(False))).drop("_name", "_known")


def same_type(a: Column, b: Column, groups=LOOK_ALIKE) -> Column:
    """Equal canonical types, or types that may be taken for each other."""
    return retrieve.group_of(a, groups) == retrieve.group_of(b, groups)


def targets(cases: DataFrame, objs: DataFrame, synonyms=None, groups=LOOK_ALIKE, cjk=OBJECTS_CJK) -> DataFrame:
    """id and the object's columns: all that a case's description fits. Place and colour count where it names them."""
    told = cases.where("expect is not null").select("id", "collection", F.nullif("expect.location", F.lit("")).alias("_at"), F.nullif("expect.color", F.lit("")).alias("_color"), F.col("expect.type").alias("_type"))
    told = with_canonical(told, "_type", "_c", synonyms, cjk).select("id", "collection", "_at", "_color", retrieve.group_of(F.col("_c"), groups).alias("_grp"))
    seen = with_canonical(objs, "type", "_c", synonyms, cjk).withColumn("_grp", retrieve.group_of(F.col("_c"), groups)).drop("_c", "_c_known")
    both = told.join(seen, ["collection", "_grp"])
    return both.where((F.col("_at").isNull() | (F.col("_at") == F.col("place"))) & (F.col("_color").isNull() | (F.col("_color") == F.col("color")))).drop("_at", "_color", "_grp")


def object_id(scene: Column, ord_: Column) -> Column:
    return F.concat(scene.cast("string"), F.lit("_o"), (ord_ - 1).cast("string"))


def owners(hits: DataFrame) -> DataFrame:
    """id, owner (the first object that fits), home (its place), knows: for each question's key what any fitting object shows, in order."""
    at = F.struct("scene_ord", "scene", "ord")
    first = hits.groupBy("id").agg(F.min(F.struct("scene_ord", "scene", "ord", "place")).alias("f"))
    shown = {"color": F.col("color"), "material": F.col("material"), "size": F.col("size"), "near": search.anchor_of(F.col("rels"), F.col("type"), search.SAFE)["anchor"]}
    told = hits.select("id", at.alias("at"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in shown.items()])).alias("t")).select("id", "at", "t.*").where("value <> ''")
    each = told.groupBy("id", "key", "value").agg(F.min("at").alias("at")).groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))  # different values only: words of the vocabulary
    known = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.transform("v", lambda x: x["value"])))).alias("knows"))
    out = first.select("id", object_id(F.col("f.scene"), F.col("f.ord")).alias("owner"), F.col("f.place").alias("home"))
    return out.join(known, "id", "left").withColumn("knows", F.coalesce("knows", F.create_map().cast("map<string,array<string>>")))


def owner_says() -> Column:
    """The answer to a reply (asked_key, options), after ``asked`` answers: as the case's script says, else what the owner can know."""
    options, nothing = F.coalesce("options", F.array().cast("array<string>")), F.array().cast("array<string>")
    values, key = F.coalesce(F.element_at("knows", F.col("asked_key")), nothing), F.col("asked_key")
    place = F.array_position(options, F.col("owner"))
    common = F.get(F.filter(options, lambda o: F.array_contains(values, o)), F.lit(0))
    told = F.when(key == dialogue.PICK, F.when(place > 0, place.cast("string")).otherwise("none")).when(key == "location", F.coalesce("home", F.lit(UNKNOWN)))
    told = told.when(F.size(options) == 1, F.when(F.array_contains(values, F.get(options, F.lit(0))), "yes").otherwise("no")).when(F.size(values) == 0, UNKNOWN).otherwise(F.coalesce(common, F.get(values, F.lit(0))))
    return F.when(F.col("asked") < F.size(F.coalesce("answers", nothing)), F.get("answers", F.col("asked"))).otherwise(told)


def play(cases: DataFrame, objs: DataFrame, places: dict[str, list[str]] | None = None, synonyms=None, groups=LOOK_ALIKE, cjk=OBJECTS_CJK) -> DataFrame:
    """A row a case: id, difficulty, known_gap, missing, asked, kind, found, text, and whether it went well in each respect.

    A conversation ends when nothing is asked any more, after MOST answers, or when nobody
    owns what is asked about. A thing that isn't indexed is missing, not wrongly reasoned.
    A case without difficulty counts as "-", one without known_gap as none.
    """
    objs, cases = cut(objs, "case-objects"), cut(cases, "cases")
    scenes = cut(search.scenes_of(objs), "case-scenes")  # for all rounds
    known = search.Entities()
    hits = cut(targets(cases, objs, synonyms, groups, cjk), "case-targets")
    about = cut(cases.join(owners(hits), "id", "left"), "case-owners")
    hear = lambda rows: requests.understood(rows, "text", places, synonyms, cjk)
    turns = cut(hear(about.select(F.col("id").alias("conv"), F.lit(1).alias("turn"), "collection", F.col("query").alias("text"))), "case-turns")
    parsed = turns.select(F.col("conv").alias("id"), F.col("said.target_type").isNotNull().alias("parse_ok"))
    states, ended = dialogue.no_states(turns.sparkSession), None
    for asked in range(MOST + 1):
        now = cut(dialogue.round_of(states, turns, objs, synonyms, groups, scenes=scenes, known=known).withColumnRenamed("conv", "id").withColumn("asked", F.lit(asked)), f"case-round-{asked}")
        both = now.join(about.select("id", "collection", "answers", "owner", "home", "knows"), "id")
        goes = F.col("kind").isin("question", "choose") & (F.lit(asked) < MOST) & (F.col("owner").isNotNull() | (F.lit(asked) < F.size(F.coalesce("answers", F.array().cast("array<string>")))))
        over = both.where(~goes).select(*now.columns)
        ended = over if ended is None else ended.unionByName(over)
        turns = both.where(goes).select(F.col("id").alias("conv"), F.lit(asked + 2).alias("turn"), "collection", owner_says().alias("text"))
        if turns.isEmpty():
            break
        turns, states = cut(hear(turns), "case-turns"), now.select(F.col("id").alias("conv"), "state")
    return judged(about, ended, hits, parsed, synonyms, groups, cjk)


def judged(about: DataFrame, ended: DataFrame, hits: DataFrame, parsed: DataFrame, synonyms=None, groups=LOOK_ALIKE, cjk=OBJECTS_CJK) -> DataFrame:
    """The last replies as results. What was found is right if its picture fits the description, or if any picture of the same thing showed the colour."""
    fits = hits.select("id", object_id(F.col("scene"), F.col("ord")).alias("found"), F.lit(True).alias("fits")).distinct()
    first = F.when(F.col("kind") == "answer", F.get("ids", F.lit(0)))
    last = ended.select("id", "kind", "asked", "text", "confidence", "place", "type", "colors", first.alias("found"))
    rows = about.select("id", F.coalesce("difficulty", F.lit("-")).alias("difficulty"), F.coalesce("known_gap", F.lit(False)).alias("known_gap"), "expect", F.col("owner").isNull().alias("lost"))
    rows = rows.join(last, "id").join(fits, ["id", "found"], "left").join(parsed, "id")
    rows = with_canonical(rows.withColumn("_type", F.col("expect.type")), "_type", "_want", synonyms, cjk)
    rows = with_canonical(rows, "type", "_got", synonyms, cjk)
    named = lambda k: F.nullif(F.col(f"expect.{k}"), F.lit(""))
    alike = (named("location").isNull() | (named("location") == F.col("place"))) & same_type(F.col("_want"), F.col("_got"), groups) & (named("color").isNull() | F.array_contains("colors", named("color")))
    missing = F.col("expect").isNotNull() & F.col("lost")
    ok = F.when(F.col("expect").isNull(), F.col("kind") == "none_found").when(missing, False).otherwise(F.col("found").isNotNull() & (F.coalesce("fits", F.lit(False)) | F.coalesce(alike, F.lit(False))))
    return rows.select(
        "id", "difficulty", "known_gap", missing.alias("missing"), ok.alias("ok"), "asked", "kind", "found", "text", "parse_ok",
        ((F.col("difficulty") == "ambiguous") & (F.col("asked") == 0) & (F.col("kind") == "answer")).alias("false_answer"),
        ((F.col("kind") != "answer") | F.coalesce(F.col("confidence").isin("high", "medium"), F.lit(False))).alias("confidence_ok"),
        ((F.col("kind") != "none_found") | F.contains("text", F.lit("photograph")) | F.contains("text", F.lit("every photo"))).alias("transparent_ok"),
        ((F.col("kind") != "question") | F.contains("text", F.lit("Candidate "))).alias("comparison_ok"),
    )


def scorecard(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts over all cases but known gaps, which are counted apart; avg_asked is of cases that asked at all, 0 without one."""
    own = ~F.col("known_gap")
    n = lambda c, name: F.count_if(own & c).alias(name)
    kind = lambda k: F.col("difficulty") == k
    return results.groupBy(*by).agg(
        n(F.lit(True), "cases"), n(F.col("ok"), "correct"), n(F.col("missing"), "missing"), F.count_if("known_gap").alias("gaps"), F.count_if(F.col("known_gap") & F.col("ok")).alias("gaps_closed"),
        n(kind("ambiguous"), "ambiguous"), n(kind("ambiguous") & (F.col("asked") > 0), "clarified"), n(F.col("false_answer"), "false_answers"), n(F.col("parse_ok"), "parsed"),
        n(F.col("confidence_ok"), "confident"), n(F.col("transparent_ok"), "transparent"), n(F.col("comparison_ok"), "compared"),
        n(kind("spatial"), "spatial"), n(kind("spatial") & F.col("ok"), "spatial_correct"), n(kind("small-object"), "small"), n(kind("small-object") & F.col("ok"), "small_correct"),
        F.round(F.coalesce(F.avg(F.when(own & (F.col("asked") > 0), F.col("asked"))), F.lit(0.0)), 6).alias("avg_asked"),
    )
