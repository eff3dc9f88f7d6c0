"""From sound to replies: phrases out of chunks, the wake gate, and the whole chain as one stream.

A device's chunks (device, seq, seconds, level, talking) are folded in order. The fold's
state is the room's level, which falls fast and rises slowly, and the phrase under way. In
a stream it lies in the state store, a value and the phrase's sound a device
(``phrases_stream``); over a table the same fold runs in the JVM, ``SEGMENT`` chunks of
every device at a time, its state handed from segment to segment (``phrases_of``). The
wake gate is state with a time to live (``gate_stream``); over a table, windows
(``gate_of``). ``replies`` chains these with a recogniser and the conversation
(``dialogue``) in one query.

Chunks of a device must come in the order of ``seq`` from batch to batch; within a batch
they are sorted. Chunks without length, and null levels, say nothing. While ``talking`` (the
machine itself speaks) a phrase under way is dropped and nothing is learned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import audio, requests, words
from ..sources.scratch import cut
from . import dialogue

# fixed values: thresholds of loudness (0 to 1), lengths in seconds
LEVEL, OVER_ROOM, PEAK_OVER_ROOM = 0.004, 4.0, 5.0
QUIET, LEAST, LONGEST = 1.2, 0.4, 15.0
AWAKE = 45.0
SEGMENT = 1 << 16
PHRASE = "device string, first long, last long, n long, spoken double, peak double, room double"
STATE = "room double, seconds double, quiet double, peak double, heard boolean, first long, last long, n long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---------------------------------------------------------------- phrases over a table


def _fold(steps: str, start: str) -> str:
    """The fold as SQL. Each chunk is three steps: what it adds, whether it is heard, whether a phrase ends; each reads only what the one before left."""
    out = "array<struct<first:bigint,last:bigint,n:bigint,spoken:double,peak:double,room:double>>"
    room = f"CASE WHEN a.room IS NULL THEN least(x.level, {LEVEL}D) WHEN x.level < a.room THEN 0.7D * a.room + 0.3D * x.level ELSE 0.97D * a.room + 0.03D * x.level END"
    loud = f"x.level > greatest({LEVEL}D, coalesce(a.room, 0D) * {OVER_ROOM}D)"
    ends = f"a.heard AND (a.quiet >= {QUIET}D OR a.seconds >= {LONGEST}D)"
    good = f"{ends} AND a.seconds - a.quiet >= {LEAST}D AND a.peak >= greatest({LEVEL}D, coalesce(a.room, 0D) * {PEAK_OVER_ROOM}D)"
    pick = lambda add, hear, end, name: f"CASE x.k WHEN 0 THEN {add} WHEN 1 THEN {hear} ELSE {end} END AS {name}"
    fresh = lambda name, empty: f"CASE WHEN {ends} THEN {empty} ELSE a.{name} END"
    reset = lambda name, empty: f"CASE WHEN x.talking THEN {empty} ELSE a.{name} END"
    fields = [
        pick(f"CASE WHEN x.talking THEN a.room ELSE {room} END", "a.room", "a.room", "room"),
        pick("CASE WHEN x.talking THEN 0D ELSE a.seconds + x.seconds END", "a.seconds", fresh("seconds", "0D"), "seconds"),
        pick(reset("quiet", "0D"), f"CASE WHEN x.talking THEN a.quiet WHEN {loud} THEN 0D WHEN a.heard THEN a.quiet + x.seconds ELSE a.quiet END", fresh("quiet", "0D"), "quiet"),
        pick("CASE WHEN x.talking THEN 0D ELSE greatest(a.peak, x.level) END", "a.peak", fresh("peak", "0D"), "peak"),
        pick(reset("heard", "false"), f"a.heard OR (NOT x.talking AND {loud})", fresh("heard", "false"), "heard"),
        pick(reset("first", "CAST(NULL AS BIGINT)"), f"CASE WHEN a.heard THEN a.first WHEN NOT x.talking AND {loud} THEN x.seq END", fresh("first", "CAST(NULL AS BIGINT)"), "first"),
        pick(reset("last", "CAST(NULL AS BIGINT)"), f"CASE WHEN NOT x.talking AND (a.heard OR {loud}) THEN x.seq ELSE a.last END", fresh("last", "CAST(NULL AS BIGINT)"), "last"),
        pick(reset("n", "0L"), f"CASE WHEN NOT x.talking AND (a.heard OR {loud}) THEN a.n + 1L ELSE a.n END", fresh("n", "0L"), "n"),
        f"CASE WHEN x.k = 2 AND {good} THEN concat(a.out, array(struct(a.first AS first, a.last AS last, a.n AS n, a.seconds - a.quiet AS spoken, a.peak AS peak, a.room AS room))) ELSE a.out END AS out",
    ]
    return f"aggregate({steps}, struct({start}, CAST(array() AS {out}) AS out), (a, x) -> struct({', '.join(fields)}))"


def phrases_of(chunks: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """PHRASE of every device: phrases in ``seq`` order, numbered alike in every run."""
    rows = chunks.where("seconds > 0 AND level IS NOT NULL AND device IS NOT NULL").select("device", F.col("seq").cast("long").alias("seq"), "seconds", "level", F.coalesce("talking", F.lit(False)).alias("talking") if "talking" in chunks.columns else F.lit(False).alias("talking"))
    rows = cut(rows.withColumn("part", F.expr(f"seq div {segment}")), "chunks")
    parts = [r[0] for r in rows.select("part").distinct().orderBy("part").collect()]  # a number a segment
    start = "CAST(s.room AS DOUBLE) AS room, coalesce(s.seconds, 0D) AS seconds, coalesce(s.quiet, 0D) AS quiet, coalesce(s.peak, 0D) AS peak, coalesce(s.heard, false) AS heard, s.first AS first, s.last AS last, coalesce(s.n, 0L) AS n"
    states = done = None
    for k in parts:
        mine = rows.where(F.col("part") == k).groupBy("device").agg(F.array_sort(F.collect_list(F.struct("seq", "seconds", "level", "talking"))).alias("chunks"))  # at most a segment
        before = mine.select("device", F.lit(None).cast(f"struct<{STATE.replace(' ', ':').replace(',:', ',')}>").alias("s")) if states is None else states
        folded = mine.join(before, "device", "left").withColumn("steps", F.expr("flatten(transform(chunks, c -> transform(array(0, 1, 2), k -> struct(k, c.seq, c.seconds, c.level, c.talking))))"))
        now = cut(folded.select("device", F.expr(_fold("steps", start)).alias("f")), "phrases")
        held = now.select("device", F.struct(*[f"f.{c.split()[0]}" for c in STATE.split(", ")]).alias("s"))
        states = held if states is None else held.unionByName(states.join(held.select("device"), "device", "left_anti"))
        found = now.select("device", F.explode("f.out").alias("p")).select("device", "p.*")
        done = found if done is None else done.unionByName(found)
    return chunks.sparkSession.createDataFrame([], PHRASE) if done is None else done


# ---------------------------------------------------------------- phrases as a stream


class Room:
    """One device's fold; ``add`` gives the phrase that a chunk ends."""

    def __init__(self, state: tuple | None = None):
        self.room, self.seconds, self.quiet, self.peak, self.heard, self.first, self.last, self.n = state or (None, 0.0, 0.0, 0.0, False, None, None, 0)

    def state(self) -> tuple:
        return self.room, self.seconds, self.quiet, self.peak, self.heard, self.first, self.last, self.n

    def reset(self) -> None:
        self.__init__((self.room, 0.0, 0.0, 0.0, False, None, None, 0))

    def add(self, seq: int, seconds: float, level: float) -> tuple[bool, dict | None]:
        """(whether the phrase under way has ended, the phrase if it is one)."""
        self.seconds, self.peak = self.seconds + seconds, max(self.peak, level)
        if self.room is None:
            self.room = min(level, LEVEL)
        else:
            self.room = 0.7 * self.room + 0.3 * level if level < self.room else 0.97 * self.room + 0.03 * level
        loud = level > max(LEVEL, self.room * OVER_ROOM)
        if not (loud or self.heard):
            return False, None
        self.quiet = 0.0 if loud else self.quiet + seconds
        self.first, self.last, self.n, self.heard = (self.first if self.heard else seq), seq, self.n + 1, True
        if self.quiet < QUIET and self.seconds < LONGEST:
            return False, None
        spoken, out = self.seconds - self.quiet, None
        if spoken >= LEAST and self.peak >= max(LEVEL, self.room * PEAK_OVER_ROOM):
            out = {"first": self.first, "last": self.last, "n": self.n, "spoken": spoken, "peak": self.peak, "room": self.room}
        self.reset()
        return True, out


class Collector(StatefulProcessor):
    """Phrases with their sound: the fold's state a value, the sound under way a list, both gone after ``idle_ms`` without a chunk."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", STATE, self.idle_ms)
        self.sound = handle.getListState("sound", "rate int, pcm binary", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        room = Room(tuple(self.fold.get()) if self.fold.exists() else None)
        kept = [tuple(r) for r in self.sound.get()] if room.heard else []
        before = len(kept)
        fresh = True  # whether what the store holds of the sound is still a part of ``kept``
        for r in sorted(rows, key=lambda r: r["seq"]):
            if not r["seconds"] or r["seconds"] <= 0 or r["level"] is None:
                continue
            if r["talking"]:
                room.reset()
                kept, fresh = [], False
                continue
            ended, phrase = room.add(r["seq"], r["seconds"], r["level"])
            if room.heard or ended:
                kept.append((r["rate"], bytes(r["pcm"] or b"")))
            if ended:
                if phrase:
                    yield Row(device=key[0], **phrase, rate=kept[-1][0], pcm=b"".join(p for _, p in kept))
                kept, fresh = [], False
        self.fold.update(room.state())
        if not fresh:
            self.sound.clear()
        if added := kept[before:] if fresh else kept:
            self.sound.appendList(added)

    def close(self) -> None:
        pass


def phrases_stream(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """PHRASE, rate, pcm of a stream of chunks that also carry ``rate`` and ``pcm`` (mono, 16 bits); ``talking`` may be missing."""
    if "talking" not in chunks.columns:
        chunks = chunks.withColumn("talking", F.lit(False))
    rows = chunks.where(F.col("device").isNotNull()).select("device", F.col("seq").cast("long").alias("seq"), "seconds", "level", F.coalesce("talking", F.lit(False)).alias("talking"), "rate", "pcm")
    return rows.groupBy("device").transformWithState(Collector(idle_ms), f"{PHRASE}, rate int, pcm binary", "Append", "None" if idle_ms is None else "ProcessingTime")


# ---------------------------------------------------------------- wake gate


def called(events: DataFrame, text: str = "text", names: list[str] | None = None, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds heard, rest and asks: whether the name is called in any spelling of its sounds, what follows it, and whether that asks for something."""
    rows = events.withColumn("_w", requests.wake_word(F.col(text), words.wake_names() if names is None else names))
    rows = rows.withColumn("heard", F.coalesce(F.col("_w.heard"), F.lit(False))).withColumn("rest", F.coalesce(F.col("_w.rest"), F.lit(""))).drop("_w")
    return requests.with_request(rows, "rest", "asks", synonyms)


def _verdict(heard: Column, asks: Column, awake: Column) -> Column:
    return F.when(heard & asks, "speak").when(heard, "woke").when(awake, "speak").otherwise("ignore")


def gate_of(events: DataFrame, ttl: float = AWAKE, enabled: bool = True) -> DataFrame:
    """Adds verdict and said to events (device, seq, at in seconds, text, heard, rest, asks).

    Awake is who was called less than ``ttl`` seconds before, or has spoken since then
    without such a gap: runs of smaller gaps, each awake behind its first call.
    """
    order = Window.partitionBy("device").orderBy("at", "seq")
    gap = F.coalesce(F.col("at") - F.lag("at").over(order) >= ttl, F.lit(True))
    runs = events.withColumn("_run", F.sum(gap.cast("int")).over(order))
    before = Window.partitionBy("device", "_run").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    awake = F.coalesce(F.max(F.col("heard").cast("int")).over(before), F.lit(0)) == 1
    told = runs.withColumn("verdict", _verdict(F.col("heard"), F.col("asks"), awake if enabled else F.lit(True)))
    return told.withColumn("said", _said()).drop("_run")


def _said() -> Column:
    return F.when(F.col("verdict") != "speak", "").when(F.col("heard"), F.col("rest")).otherwise(F.col("text"))


class Gate(StatefulProcessor):
    """Until when a device is awake; forgotten after ``idle_ms``."""

    def __init__(self, ttl: float, enabled: bool, idle_ms: int | None):
        self.ttl, self.enabled, self.idle_ms = ttl, enabled, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "at double", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        until = self.until.get()[0] if self.until.exists() else None
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            awake = not self.enabled or (until is not None and r["at"] < until)
            if r["heard"] or awake:
                until = r["at"] + self.ttl
            verdict = ("speak" if r["asks"] else "woke") if r["heard"] else "speak" if awake else "ignore"
            said = "" if verdict != "speak" else r["rest"] if r["heard"] else r["text"]
            yield Row(device=key[0], seq=r["seq"], at=r["at"], text=r["text"], verdict=verdict, said=said)
        if until is not None:
            self.until.update((until,))

    def close(self) -> None:
        pass


def gate_stream(events: DataFrame, ttl: float = AWAKE, enabled: bool = True, idle_ms: int | None = None) -> DataFrame:
    """device, seq, at, text, verdict, said of a stream of events as ``called`` gives them."""
    rows = events.where(F.col("device").isNotNull() & F.col("at").isNotNull()).select("device", F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"), "text", "heard", "rest", "asks")
    return rows.groupBy("device").transformWithState(Gate(ttl, enabled, idle_ms), "device string, seq long, at double, text string, verdict string, said string", "Append", "None" if idle_ms is None else "ProcessingTime")


# ---------------------------------------------------------------- the chain


def recognised(phrases: DataFrame, hear: Callable[[np.ndarray], str | None]) -> DataFrame:
    """device, seq, at, text: what a recogniser of floats at 16 kHz hears in each phrase; phrases in which it hears nothing go."""

    def run(batches):
        for batch in batches:
            heard = [hear(audio.resampled(audio.mono(pcm or b"", 2, 1), rate or audio.RATE)) for rate, pcm in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(heard, pa.string())], names=["device", "seq", "at", "text"])

    rows = phrases.select("device", F.col("last").alias("seq"), "rate", "pcm", F.col("at"))
    return rows.mapInArrow(run, "device string, seq long, at double, text string").where(F.trim("text") != "")


def turns_stream(chunks: DataFrame, hear: Callable[[np.ndarray], str | None], seconds: float = 0.4, ttl: float = AWAKE, enabled: bool = True, idle_ms: int | None = None) -> DataFrame:
    """Chunks to turns: phrases, text, gate. ``seconds``: the length of a chunk, which makes ``seq`` a time."""
    phrases = phrases_stream(chunks, idle_ms).withColumn("at", F.col("last") * float(seconds))
    return gate_stream(called(recognised(phrases, hear)), ttl, enabled, idle_ms)


def replies(chunks: DataFrame, hear: Callable[[np.ndarray], str | None], objs: DataFrame, collections: Column, out: str, places: dict[str, list[str]] | None = None, **more):
    """A writer that answers a stream of chunks: one query from sound to replies below ``out``. ``collections``: a device's collection."""
    spoken = turns_stream(chunks, hear, **more).where("verdict = 'speak'")
    turns = spoken.select(F.col("device").alias("conv"), F.col("seq").cast("int").alias("turn"), collections.alias("collection"), F.col("said").alias("text"))
    return dialogue.stream(requests.understood(turns, "text", places), objs, out)
