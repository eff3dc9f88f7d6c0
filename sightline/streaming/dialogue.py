"""The clarifying conversation, for any number of conversations at once.

A round takes one turn of every conversation: what was said (``requests.understood``)
changes the conversation's state and gives the searches it needs (``listen``); one plan
answers the searches of all conversations (``search.find_candidates``), among them one
for each constraint that might have to go; the entities found give the reply
(``decide``). States are JSON strings; between rounds they lie in the shared folder.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import requests
from ..operators import search
from ..sources.scratch import cut

# fixed values: the questions' order and weight, how many are shown, kinds of questions that ask for no attribute
WEIGHT = {"color": 1.3, "near": 0.8, "size": 0.9, "material": 0.7, "location": 1.1}
SHOWN, COMPARED, MOST_TURNS, TOP = 4, 3, 3, 5
PICK, CONFIRM = "__pick__", "confirm_candidate"
# fixed values: sentences
ASKS = {
    "color": ("What colour is yours?", "Do you remember its colour?", "Which colour matches your item?"),
    "near": ("Was it near anything you remember?", "Do you remember what it was next to?", "Was it close to something specific?"),
    "size": ("Roughly how big was it?", "Would you call it small, medium, or large?", "Which size sounds right for it?"),
    "material": ("What was it made of?", "Do you remember the material?", "Which material fits your item?"),
    "location": ("Which location sounds right?", "Do you remember the room or area?", "Where do you think you left it?"),
}
NO_ITEM = 'I\'m not sure what object you\'re looking for. Could you name the item? For example: "my black bottle".'
UNSURE = " The match is medium-confidence, so please check the image."

REPLY = "kind string, text string, asked_key string, options array<string>, confidence string, ids array<string>, n int, place string, type string, color string, predicate string, anchor string, target string, colors array<string>"
HEARD = f"conv string, turn int, collection string, state string, done boolean, {REPLY}, searches array<struct<{search.REQUEST.replace(' array<', ':array<').replace(' string', ':string').replace(' int', ':int')}>>"
FOUND = ("n", "band", "place", "scene", "ord", "type", "color", "material", "size", "colors", "near", "predicate", "anchor")


def opened(said: dict) -> dict:
    """A new conversation's state."""
    return {
        "target": said["target_type"], "attributes": {"color": said["color"]} if said["color"] else {}, "predicate": said["predicate"], "anchor": said["anchor_type"], "location": said["location"],
        "learned": {}, "asked": [], "key": None, "options": [], "picked": None, "refused": False, "offered": False, "turns": 0, "shown": [], "rejected": [], "confirmed": False, "all": bool(said["all"]), "looked": {},
    }


def is_new_question(s: dict, said: dict) -> bool:
    """Another thing is named, or the same one in a question. While a question is pending, an offered thing, any neighbour asked for, and a bare relation are answers - unless the turn opens like a question."""
    if not said["target_type"]:
        return False
    if s["key"] and not said["opens"]:
        bare = said["predicate"] is None and said["phrase"]
        if said["target_type"] in s["options"] or s["key"] == "near" or bare:
            return False
    return said["target_type"] != s["target"] or bool(said["opens"])


def learn(s: dict, key: str, value, negated: bool = False) -> None:
    s["learned"][key] = [value, negated]


def knows(s: dict, key: str, value) -> bool:
    return s["learned"].get(key) == [value, False]


def refine(s: dict, said: dict) -> None:
    """More about the same thing; news gives the questions back."""
    news = False
    for key, value in (("color", said["color"]), ("near", said["anchor_type"] if said["anchor_type"] != s["target"] else None)):
        if value and not knows(s, key, value):
            learn(s, key, value)
            news = True
    if said["location"] and said["location"] != s["location"]:
        s["location"], news = said["location"], True
    if news:
        s |= {"turns": 0, "refused": False, "offered": False}


def pick(s: dict, said: dict, options: list[str]) -> bool:
    if said["none"]:
        s["refused"] = True
        return False
    at = None
    if said["digits"]:
        at = None if said["number"] is None else said["number"] - 1
    else:
        at = next((i for i, w in enumerate(requests.ORDINALS) if w in said["low"] and i < len(options)), None)
    if at is None or not 0 <= at < len(options):
        return False
    s["picked"] = options[at]
    return True


def volunteered(s: dict, said: dict, asked: str) -> None:
    """Attributes told without being asked for; a neighbour only with a relation that holds from any side."""
    others = [t for t in said["types"] if t != s["target"]]
    told = {"color": next(iter(said["colors"]), None), "size": said["size"], "material": said["material"], "near": others[0] if others and said["phrase"] and said["relation"] in search.SAFE else None}
    for key, value in told.items():
        if value and key != asked and key not in s["learned"]:
            learn(s, key, value)


def offered_in(low: str, options: list[str]) -> str | None:
    return next((o for o in options if o.lower() in low or low in o.lower()), None)


def record(s: dict, said: dict, key: str, options: list[str]) -> None:
    """What an answer to the question ``key`` says."""
    if key == PICK:
        if not pick(s, said, options) and not s["refused"]:
            refine(s, said)
        return
    if key == CONFIRM:
        if said["sure"]:
            s["confirmed"] = True
        elif s["shown"]:
            s["rejected"].append(s["shown"][0]["id"])
        return
    if said["unknowing"]:
        return
    volunteered(s, said, key)
    if key != "location" and not s["location"] and said["location"]:
        s["location"] = said["location"]
    value = None
    if key == "color":
        value = next((c for c in said["colors"] if c in options), None) or next((o for o in options if o in said["low"]), None) or next(iter(said["colors"]), None)
    elif key == "location":
        value = offered_in(said["low"], options)
    elif key == "near":
        others = [t for t in said["types"] if t != s["target"]]
        value = next((t for t in others if t in options), None) or next(iter(others), None)
    else:
        value = said.get(key)
    if value:
        learn(s, key, value)
    elif key in ("color", "location"):
        return
    elif len(options) == 1:  # a question of yes or no
        if said["yes"] or said["no"]:
            learn(s, key, options[0], not said["yes"])
    elif value := offered_in(said["low"], options):
        learn(s, key, value)


def answered(s: dict, said: dict) -> None:
    key, options, before = s["key"], s["options"], json.dumps(s["learned"])
    s["key"], s["options"] = None, []
    s["asked"].append(key)
    record(s, said, key, options)
    if key not in s["learned"] and json.dumps(s["learned"]) != before:  # another question was answered: this one may come again
        s["asked"].remove(key)


def wanted(s: dict, but: str | None = None) -> list[dict]:
    told = {k: [v, False] for k, v in s["attributes"].items()} | {k: v for k, v in s["learned"].items() if k != but}
    return [{"key": k, "value": v, "negated": negated} for k, (v, negated) in told.items()]


def reply(kind: str, text: str, found: list[dict] = (), **more) -> dict:
    first = found[0] if found else {}
    return {"kind": kind, "text": text, "asked_key": None, "options": [], "confidence": None, "ids": [ident(c) for c in found], "n": len(found), "target": None} | {k: first.get(k) for k in ("place", "type", "color", "predicate", "anchor")} | {"colors": colors_of(first)} | more


def colors_of(c: dict) -> list[str]:
    """All colours that any view of an entity shows."""
    return c.get("colors") or [e["v"] for e in c.get("seen") or [] if e["k"] == "color"]


def ident(c: dict) -> str:
    return c.get("id") or f"{c['scene']}_o{c['ord'] - 1}"


def listen(s: dict | None, said: dict) -> tuple[dict, dict | None, list[dict]]:
    """The state after a turn, a reply that needs no search, the searches that are needed."""
    if s is None or is_new_question(s, said):
        s = opened(said)
    elif s["key"]:
        answered(s, said)
    else:
        refine(s, said)
    return advance(s)


def choose(s: dict, at: int) -> tuple[dict, dict | None, list[dict]] | None:
    """The same for a finger on the picture at a place; None where there is none."""
    pool = s["options"] if s["key"] == PICK else [c["id"] for c in s["shown"]]
    if not 0 <= at < len(pool):
        return None
    s |= {"key": None, "options": [], "picked": pool[at]}
    return advance(s)


def advance(s: dict) -> tuple[dict, dict | None, list[dict]]:
    if not s["target"]:
        return s, reply("none_found", NO_ITEM), []
    if s["refused"]:
        s["refused"] = False
        places = sorted({c["place"] for c in s["shown"]})
        return s, reply("none_found", f"Then I don't have it. I checked every photo I have of {' and '.join(places)} and those were all the {s['target']}s in them.", place=" and ".join(places), target=s["target"]), []
    if s["picked"]:
        one = [c for c in s["shown"] if c["id"] == s["picked"]]
        s["picked"] = None
        if one:
            return s, reply("answer", f"That one is {place_text(one[0])}.", one, target=s["target"]), []
    drops = [None, *reversed(s["learned"])]
    base = {"target": s["target"], "color": s["attributes"].get("color"), "predicate": s["predicate"], "anchor": s["anchor"], "location": s["location"], "attributes": len(s["attributes"])}
    ask = [base | {"rid": str(i), "wanted": wanted(s, k), "top": None if s["all"] and not i else TOP} for i, k in enumerate(drops)]
    if s["all"]:  # whether there is anything at all is asked of the best scenes
        ask.append(base | {"rid": "near", "wanted": wanted(s), "top": TOP})
    return s, None, ask


def place_text(c: dict) -> str:
    where = f"in the {c['place']}"
    if not c.get("anchor"):
        return where
    how = "on top of" if c["predicate"] == "on" else c["predicate"].replace("_", " ")
    return f"{where}, {how} the {c['anchor']}" + (" in this photo" if c["predicate"] in search.PICTURED else "")


def compared(found: list[dict]) -> str:
    lines = []
    for i, c in enumerate(found[:COMPARED]):
        told = place_text(c).partition(", ")[2]
        bits = list(dict.fromkeys(b for b in (c["color"], c["material"], c["size"], c["type"], c["place"], told) if b))
        lines.append(f"Candidate {chr(65 + i)}: {', '.join(bits[:5])}")
    return "\n".join(lines)


def called(s: dict, c: dict) -> str:
    """Colour and type, in the owner's word for the colour if any view agrees."""
    own = [w["value"] for w in wanted(s) if w["key"] == "color" and not w["negated"]]
    color = own[0] if own and own[0] in colors_of(c) else c["color"]
    return " ".join(b for b in (color, c["type"]) if b)


def described(s: dict) -> str:
    """The request in words."""
    out = " ".join([*s["attributes"].values(), s["target"]])
    if s["predicate"] and s["anchor"]:
        out += f" {s['predicate'].replace('_', ' ')} the {s['anchor']}"
    return out + (f" in {s['location']}" if s["location"] else "")


def best_question(found: list[dict], asked: list[str]) -> tuple[str | None, list[str]]:
    """The key that divides most by its weight, the earlier of equal ones, and its values in order."""
    best, most, options = None, 0.0, []
    for key, weight in WEIGHT.items():
        values = [c["place"] if key == "location" else c[key] for c in found]
        known = [v for v in values if v]
        if key in asked or len(set(known)) < 2:
            continue
        split = (1 - max(map(known.count, set(known))) / len(values)) * (len(known) / len(values)) * weight
        if split > most:
            best, most, options = key, split, list(dict.fromkeys(known))
    return best, options


def brief(s: dict, c: dict) -> dict:
    return {"id": ident(c), "colors": colors_of(c)} | {k: c[k] for k in ("place", "type", "color", "predicate", "anchor")}


def decide(s: dict, found: dict[str, list[dict]]) -> tuple[dict, dict]:
    """The reply to what the searches found."""
    target = {"target": s["target"]}
    own = [c for c in found.get("near" if s["all"] else "0", []) if ident(c) not in s["rejected"]]
    if not own:
        for i, key in enumerate(reversed(list(s["learned"])), 1):
            if again := found.get(str(i)):
                value, negated = s["learned"].pop(key)
                s["shown"] = [brief(s, c) for c in again]
                label = f"not {value}" if negated else value
                return s, reply("giveup", f"I couldn't find anything matching \"{label}\". Here is the closest I have for \"{described(s)}\":", again[:COMPARED], **target)
        s["shown"] = []
        color = s["attributes"].get("color")
        return s, reply("none_found", f"I couldn't find a {described(s)}. It may be outside the photographed area or hidden from view.", color=color, type=s["target"], **target)
    if s["all"]:
        every = [c for c in found.get("0", []) if ident(c) not in s["rejected"]] or own
        every = [c for c in every if c["type"] == s["target"]] or every
        s["shown"] = [brief(s, c) for c in every]
        many = s["target"] if len(every) == 1 or s["target"].endswith("s") else s["target"] + "s"
        lines = [f"{i}. {called(s, c)} - {place_text(c)}" for i, c in enumerate(every, 1)]
        return s, reply("list", "\n".join([f"I found {len(every)} {many}:", *lines]), every, **target)
    s["shown"] = [brief(s, c) for c in own]
    if len(own) == 1:
        c = own[0]
        if c["band"] == "low" and not s["confirmed"]:
            s["key"], s["options"] = CONFIRM, ["yes", "no"]
            return s, reply("question", f"I found one low-confidence possible match, so I don't want to guess. Is this your {described(s)}?\n{compared(own)}", own, asked_key=CONFIRM, options=["yes", "no"], confidence="low", **target)
        sure = c["band"] == "high"
        text = f"{'Found it' if sure else 'I think I found it'} - the {called(s, c)} is {place_text(c)}.{'' if sure else UNSURE}"
        return s, reply("answer", text, own, confidence=c["band"], **target | {"color": called(s, c).removesuffix(c["type"] or "").strip() or None})
    key, options = best_question(own, s["asked"]) if s["turns"] < MOST_TURNS else (None, [])
    if key is None:
        if s["offered"]:
            return s, reply("giveup", f"I still see {len(own)} possible matches. Here are the most likely ones:\n{compared(own)}", own[:COMPARED], confidence="medium", **target)
        s |= {"turns": s["turns"] + 1, "offered": True, "key": PICK, "options": [ident(c) for c in own[:SHOWN]]}
        shown = len(s["options"])
        return s, reply("choose", f'I found {len(own)} that I cannot tell apart from their descriptions. Here they are - which one is yours? (1-{shown}, or "none")', own[:SHOWN], asked_key=PICK, options=s["options"], **target)
    asks = ASKS[key][s["turns"] % len(ASKS[key])]
    s |= {"turns": s["turns"] + 1, "key": key, "options": options}
    return s, reply("question", f"I found {len(own)} possible matches. {asks} ({' or '.join(options)})\n{compared(own)}", own, asked_key=key, options=options, confidence="medium", **target)


# ---------------------------------------------------------------- rounds over tables


def _rows(df: DataFrame, out: str, make) -> DataFrame:
    """A row in, a row out, as dicts."""
    kind = T.StructType.fromDDL(out)
    schema = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in map(make, batch.to_pylist())], schema=schema)

    return df.mapInArrow(run, kind)


def _hear(r: dict) -> dict:
    s, told, ask = listen(json.loads(r["state"]) if r["state"] else None, r["said"])
    mine = [a | {"rid": f"{r['conv']}|{a['rid']}", "collection": r["collection"]} for a in ask]
    return r | {"state": json.dumps(s), "done": told is not None, "searches": mine} | (told or {})


def _tell(r: dict) -> dict:
    if r["done"]:
        return r
    s, found = json.loads(r["state"]), {}
    for f in json.loads(r["found"] or "[]"):
        found.setdefault(f["which"], []).append(f["c"])
    for seen in r["looks"] or []:
        s["looked"][seen["id"]] = seen["gone"]
    main = "near" if s["all"] else "0"
    # a look never takes everything away
    if left := [c for c in found.get(main, []) if not s["looked"].get(ident(c))]:
        found = {which: [c for c in own if not s["looked"].get(ident(c))] if which in (main, "0") else own for which, own in found.items()}
    s, told = decide(s, found)
    return r | told | {"state": json.dumps(s)}


LOOKED = "conv string, id string, gone boolean"


def looks_of(heard: DataFrame, found: DataFrame, objs: DataFrame, look) -> DataFrame:
    """LOOKED: verdicts on the candidates that are worth a second look and had none in their conversation yet.

    ``look`` takes conv, id, collection, scene, ord, description and crop (within the
    frame, where ``objs`` has w and h) and adds match and confidence; it gets each object
    once a conversation, and runs once.
    """
    asked = heard.where(~F.col("done")).select("conv", "collection", F.col("state"), F.explode("searches").alias("q"))
    seen = F.from_json(F.get_json_object("state", "$.looked"), "map<string,boolean>")
    main = F.when(F.get_json_object("state", "$.all") == "true", "near").otherwise("0")
    ask = asked.withColumn("seen", seen).where(F.substring_index("q.rid", "|", -1) == main).select("conv", "collection", "seen", F.col("q.rid").alias("rid"), F.concat_ws(" ", "q.color", "q.target").alias("description"))
    at = found.select("rid", "n", "scene", "ord", "score").join(ask, "rid")
    frame = [F.col(c) if c in objs.columns else F.lit(None).cast("int").alias(c) for c in ("w", "h")]
    own = objs.select("collection", F.col("scene").alias("scene"), "ord", "box", *frame)
    cands = at.join(own, ["collection", "scene", "ord"]).withColumn("id", F.concat(F.col("scene").cast("string"), F.lit("_o"), (F.col("ord") - 1).cast("string")))
    new = cands.where(search.needs_look(F.col("score"), F.col("box"), F.col("w"), F.col("h")) & ~F.coalesce(F.map_contains_key("seen", F.col("id")), F.lit(False)))
    asked_of = new.select("conv", "id", "collection", "scene", "ord", "description", search.crop(F.col("box"), F.col("w"), F.col("h")).alias("crop")).dropDuplicates(["conv", "id"])
    gone = F.coalesce((F.col("match") == F.lit(False)) & (F.coalesce("confidence", F.lit(0.0)) >= search.SURE), F.lit(False))
    return cut(look(asked_of).select("conv", "id", gone.alias("gone")), "looks")


def round_of(states: DataFrame, turns: DataFrame, objs: DataFrame, synonyms=None, groups=search.LOOK_ALIKE, look=None, scenes: DataFrame | None = None, known: search.Entities | None = None) -> DataFrame:
    """One turn of every conversation (conv, turn, collection, said): its reply and new state; with ``look``, doubtful candidates are looked at again first (``looks_of``). ``scenes`` and ``known`` as for ``search.find_candidates``."""
    heard = _rows(turns.select("conv", "turn", "collection", "said").join(states.select("conv", "state"), "conv", "left"), HEARD, _hear)
    heard = cut(heard, "heard")  # Python's part runs once
    found = search.find_candidates(heard.select(F.explode("searches").alias("q")).select("q.*"), objs, synonyms, groups, scenes, known)
    found = found if look is None else cut(found, "found")  # read twice then
    told = found.withColumn("scene", F.col("scene").cast("string"))
    item = F.struct(F.substring_index("rid", "|", -1).alias("which"), F.struct(*FOUND).alias("c"))  # in order of n
    each = told.groupBy(F.substring_index("rid", "|", 1).alias("conv")).agg(F.to_json(F.array_sort(F.collect_list(item)), {"ignoreNullFields": "false"}).alias("found"))  # a reply's own entities
    if look is None:
        each = each.withColumn("looks", F.lit(None).cast("array<struct<id:string,gone:boolean>>"))
    else:
        seen = looks_of(heard, found, objs, look).groupBy("conv").agg(F.collect_list(F.struct("id", "gone")).alias("looks"))
        each = each.join(seen, "conv", "left")
    out = f"conv string, turn int, state string, done boolean, {REPLY}"
    return _rows(heard.drop("searches", "collection").join(each, "conv", "left"), out, _tell)


def no_states(spark) -> DataFrame:
    """Nobody has spoken yet; planned without Python's workers."""
    return spark.range(0).select(F.col("id").cast("string").alias("conv"), F.lit(None).cast("string").alias("state"))


def replay(turns: DataFrame, objs: DataFrame, synonyms=None, groups=search.LOOK_ALIKE, look=None) -> DataFrame:
    """conv, turn and reply of every turn (conv, turn from 1 without gaps, collection, said)."""
    turns, objs = cut(turns.select("conv", "turn", "collection", "said"), "turns"), cut(objs, "objects")
    scenes = cut(search.scenes_of(objs), "scenes")  # for all rounds
    known = search.Entities()
    states, done = no_states(turns.sparkSession), None
    for k in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
        now = cut(round_of(states, turns.where(F.col("turn") == k), objs, synonyms, groups, look, scenes, known), f"round-{k}")
        states = cut(now.select("conv", "state").unionByName(states.select("conv", "state").join(now.select("conv"), "conv", "left_anti")), "states")  # no plan grows with the turns
        done = now if done is None else done.unionByName(now)
    if done is None:
        return turns.sparkSession.createDataFrame([], f"conv string, turn int, {REPLY}")
    return done.drop("state", "done")


COMPACT = 64  # batches whose states are read one by one
STATES = "conv string, state string, batch long"


def states_of(spark, out: str, number: int) -> DataFrame:
    """STATES as they were before batch ``number``: the last full table, and what each batch since then has written."""
    base = number // COMPACT * COMPACT
    parts = [f"{out}/states/{k}" for k in range(base, number)] + ([f"{out}/bases/{base}"] if base else [])
    return spark.read.schema(STATES).parquet(*parts) if parts else spark.createDataFrame([], STATES)


def newest(states: DataFrame) -> DataFrame:
    return states.groupBy("conv").agg(F.max_by("state", "batch").alias("state"), F.max("batch").alias("batch"))


def answerer(objs: DataFrame, out: str, synonyms=None, groups=search.LOOK_ALIKE, look=None):
    """A function of a micro-batch and its number that writes the states of the conversations in it, and their replies.

    A batch writes no state but these. Every COMPACT batches the states written since the
    last full table become a new one. A batch that is run again reads the states before it
    and writes the same in their place.
    """

    def answer(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number and number % COMPACT == 0:
            newest(states_of(spark, out, number - 1).unionByName(spark.read.schema(STATES).parquet(f"{out}/states/{number - 1}"))).write.mode("overwrite").parquet(f"{out}/bases/{number}")
        batch = cut(batch.select("conv", "turn", "collection", "said", F.row_number().over(Window.partitionBy("conv").orderBy("turn")).alias("k")), "batch")
        states = newest(states_of(spark, out, number).join(batch.select("conv").distinct(), "conv", "left_semi")).select("conv", "state")
        done = None
        for k in range(1, (batch.agg(F.max("k")).first()[0] or 0) + 1):
            now = cut(round_of(states, batch.where(F.col("k") == k), objs, synonyms, groups, look), "stream-round")
            states = cut(now.select("conv", "state").unionByName(states.join(now.select("conv"), "conv", "left_anti").select("conv", "state")), "stream-states")
            done = now if done is None else done.unionByName(now)
        states.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/states/{number}")
        if done is not None:
            done.drop("state", "done").write.mode("overwrite").parquet(f"{out}/replies/batch={number}")

    return answer


def stream(turns: DataFrame, objs: DataFrame, out: str, synonyms=None, groups=search.LOOK_ALIKE, look=None):
    """A writer that answers a stream of turns, a micro-batch a time; states and replies lie below ``out``. Turns of one conversation in one batch are taken in order."""
    return turns.writeStream.foreachBatch(answerer(objs, out, synonyms, groups, look)).option("checkpointLocation", f"{out}/checkpoint")


def localized(lang):
    """A reply's text in the language (ko, zh); English as it is."""
    what = requests.object_text(F.col("color"), F.col("type"), lang)
    asked = requests.object_text(F.col("color"), F.col("target"), lang)
    where = requests.place_said(F.col("place"), F.col("predicate"), F.col("anchor"), lang)
    kind, say = F.col("kind"), requests.sentence
    answer = F.when(F.col("confidence") == "medium", say("found_unsure", lang, what=what, where=where)).otherwise(say("found", lang, what=what, where=where))
    out = F.when(kind == "answer", answer).when(kind == "choose", say("choose", lang, n=F.col("n"))).when(kind == "giveup", say("give_up", lang, n=F.col("n")))
    for key in WEIGHT:
        out = out.when((kind == "question") & (F.col("asked_key") == key), say(f"ask_{key}", lang, n=F.col("n"), options=requests.choices(key, F.col("options"), lang)))
    out = out.when(kind == "list", say("found_all", lang, n=F.col("n"), what=requests.name_of("type", F.col("target"), lang)))
    out = out.when((kind == "none_found") & F.col("target").isNull(), say("no_target", lang)).when((kind == "none_found") & F.col("place").isNotNull(), say("not_here", lang, where=F.col("place"))).when(kind == "none_found", say("not_found", lang, what=asked))
    return F.when(lang == "en", F.col("text")).otherwise(F.coalesce(out, F.col("text")))
