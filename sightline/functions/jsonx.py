"""Objects out of model answers: JSON in fences, in prose, or cut off.

Text that Spark's own reader understands stays in the JVM; only the rest goes to a
tolerant reader in Python, which keeps every member and element that is whole.
"""

from __future__ import annotations

import json
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBJECT = "struct<type:string,color:string,material:string,size:string,bbox:array<double>,confidence:double>"
SCHEMA = f"n_objects int, objects array<{OBJECT}>, caption string"
LOOSE = "n_objects int, objects array<struct<type:string,color:string,material:string,size:string,bbox:array<double>,confidence:double>>, caption string, truncated boolean"
DEEPEST = 60


class Torn(Exception):
    """The text ends, or stops being JSON, within a value."""


def _no_constant(word: str):
    raise ValueError(word)  # NaN and the like aren't JSON


#: Python's own scanner: (value, end) of a value that is whole and plain JSON.
_SCAN = json.JSONDecoder(parse_constant=_no_constant, strict=False).scan_once


class Reader:
    """JSON up to where the text tears: ``whole`` tells whether it did, and what was complete by then is kept."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at, self.whole = text, at, True

    def blank(self) -> str:
        while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
            self.at += 1
        if self.at >= len(self.text):
            raise Torn
        return self.text[self.at]

    def value(self, depth: int = 0):
        c = self.blank()
        if depth > DEEPEST:
            raise Torn
        if c in "{[" and (plain := self.plain(depth)) is not None:
            return plain
        if c == "{":
            return self.members({}, "}", depth)
        if c == "[":
            return self.members([], "]", depth)
        if c == '"':
            return self.string()
        end = self.at
        while end < len(self.text) and self.text[end] not in ",]} \t\r\n":
            end += 1
        word, names = self.text[self.at : end], {"true": True, "false": False, "null": None}
        if end == len(self.text):
            raise Torn
        self.at = end
        if word in names:
            return names[word]
        try:
            return float(word) if any(x in word for x in ".eE") else int(word)
        except ValueError:
            raise Torn from None

    def plain(self, depth: int):
        """A whole object or list by Python's scanner; None where it fails, or may lie too deep."""
        try:
            got, end = _SCAN(self.text, self.at)
        except (ValueError, StopIteration, RecursionError):
            return None
        if depth + self.text.count("{", self.at, end) + self.text.count("[", self.at, end) > DEEPEST:
            return None
        self.at = end
        return got

    def members(self, held, close: str, depth: int):
        """What stands in braces or brackets; of a torn one, all that came before, unless it lies in a list: there it goes."""
        self.at += 1
        try:
            if self.blank() == close:
                self.at += 1
                return held
            while True:
                key = None
                if close == "}":
                    if self.blank() != '"':
                        raise Torn
                    key = self.string()
                    if self.blank() != ":":
                        raise Torn
                    self.at += 1
                inner = self.value(depth + 1)
                if not self.whole and close == "]" and not isinstance(inner, list):
                    return held
                if key is None:
                    held.append(inner)
                else:
                    held[key] = inner
                if not self.whole:
                    return held
                c = self.blank()
                self.at += 1
                if c == close:
                    return held
                if c != ",":
                    raise Torn
        except Torn:
            self.whole = False
            return held

    def string(self) -> str:
        try:
            out, self.at = scanstring(self.text, self.at + 1, False)
            return out
        except ValueError:  # torn, or escaped in a way of its own
            pass
        out, i = [], self.at + 1
        plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
        while i < len(self.text) and self.text[i] != '"':
            c = self.text[i]
            if c == "\\" and i + 1 < len(self.text):
                i += 1
                c = self.text[i]
                if c == "u":
                    try:
                        c = chr(int(self.text[i + 1 : i + 5], 16))
                    except ValueError:
                        raise Torn from None
                    i += 4
                else:
                    c = plain.get(c, c)
            out.append(c)
            i += 1
        if i >= len(self.text):
            raise Torn
        self.at = i + 1
        return "".join(out)


def extract(text: str | None) -> dict | None:
    """The first object of the text that tells of objects; cut off, its detections with a box that are whole, marked truncated; None where there is none."""
    at = -1
    while text and (at := text.find("{", at + 1)) >= 0:
        reader = Reader(text, at)
        got = reader.value()
        told = got.get("objects") if isinstance(got.get("objects"), list) else None
        if reader.whole and (told is not None or "n_objects" in got or "caption" in got):
            return {**got, "objects": told or [], "truncated": False}
        if not reader.whole and told:
            kept = [o for o in told if isinstance(o, dict) and "bbox" in o]
            if kept:
                return {**got, "objects": kept, "truncated": True}
    return None


def _number(x):
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def _object(o: dict) -> dict:
    inner = o.get("attributes") if isinstance(o.get("attributes"), dict) else o
    text = lambda v: v if isinstance(v, str) else None
    box = o.get("bbox")
    return {"type": text(o.get("type")), **{k: text(inner.get(k)) for k in ("color", "material", "size")}, "bbox": [_number(x) for x in box] if isinstance(box, list) else None, "confidence": _number(o.get("confidence"))}


def with_answer(df: DataFrame, raw: str, out: str) -> DataFrame:
    """``out``: struct of LOOSE from a model's text; all null where nothing can be read."""
    body = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```\w*\s*(\{.*?\})\s*```", 1), F.lit("")), F.trim(F.col(raw)))
    strict = F.from_json(F.when(body.rlike(r"^\{") & ~F.contains(body, F.lit('"attributes"')), body), SCHEMA)

    @F.pandas_udf(LOOSE)
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            got = extract(text) or {}
            n, caption = _number(got.get("n_objects")), got.get("caption")
            rows.append({"n_objects": None if n is None else int(n), "objects": [_object(o) for o in got["objects"] if isinstance(o, dict)] if got else None, "caption": caption if isinstance(caption, str) else None, "truncated": got.get("truncated")})
        return pd.DataFrame(rows, columns=["n_objects", "objects", "caption", "truncated"]).astype({"n_objects": "Int32", "truncated": "object"})

    df = df.withColumn("_strict", strict)
    fine = F.col("_strict.objects").isNotNull()
    df = df.withColumn("_loose", read(F.when(~fine, F.col(raw))))
    return df.withColumn(out, F.when(fine, F.struct("_strict.n_objects", "_strict.objects", "_strict.caption", F.lit(False).alias("truncated"))).otherwise(F.col("_loose"))).drop("_strict", "_loose")


def miscounted(answer: Column) -> Column:
    """Whether the answer claims another number of objects than it lists."""
    return F.coalesce(answer["n_objects"] != F.size(answer["objects"]), F.lit(False))


OBJECT_ROW = "ord int, type string, color string, material string, size string, bbox array<double>, confidence double, truncated boolean"


class Salvaged:
    """Table function: a row each object that can be read in a model's text; none where nothing can. Made a UDTF by ``salvaged``."""

    def eval(self, raw: str, outer: bool):
        got = extract(raw)
        if outer and not (got and any(isinstance(o, dict) for o in got["objects"])):
            yield (None,) * 8
        for at, o in enumerate([o for o in got["objects"] if isinstance(o, dict)] if got else [], 1):
            o = _object(o)
            yield at, o["type"], o["color"], o["material"], o["size"], o["bbox"], o["confidence"], got["truncated"]


def salvaged(df: DataFrame, raw: str, outer: bool = False) -> DataFrame:
    """df with a row each object of OBJECT_ROW that the text ``raw`` holds, by lateral join; with ``outer`` also rows without any, their ord null."""
    rows = F.udtf(Salvaged, returnType=OBJECT_ROW)
    return df.lateralJoin(rows(F.col(raw).outer(), F.lit(outer)))
