"""Words of requests: normal forms, scripts, and dictionary matching as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import constant_map, constant_words, quoted
from .words import OBJECTS, TRADITIONAL

# fixed values: the controlled vocabulary
COLORS = ["black", "white", "gray", "silver", "red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "beige", "gold", "transparent", "multicolor"]
COLOR_ALIASES = {
    "dark": "black", "dark gray": "black", "dark grey": "black", "charcoal": "black", "grey": "gray", "light gray": "gray",
    "light grey": "gray", "navy": "blue", "sky blue": "blue", "light blue": "blue", "dark blue": "blue", "teal": "blue",
    "maroon": "red", "burgundy": "red", "crimson": "red", "clear": "transparent", "see-through": "transparent",
    "cream": "beige", "tan": "beige", "khaki": "beige", "golden": "gold", "yellowish": "yellow", "violet": "purple",
}
#: English words for objects, and the type of each; of two types with one word, the later.
OBJECT_WORDS = {w: t for t, ws in OBJECTS.items() for w in ws}
LOOK_ALIKE = [("bottle", "tumbler", "mug", "cup"), ("charger", "cable", "power bank"), ("backpack", "umbrella")]


def padded(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits one blank, a blank at each end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def language(text: Column) -> Column:
    """ko with any Hangul, else zh with any Han, else en."""
    return F.when(text.rlike(r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7A3}]"), "ko").when(text.rlike(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"), "zh").otherwise("en")


def mapped(value: Column, table: dict[str, str]) -> Column:
    """The table's value, else the trimmed, lower-case value itself."""
    clean = F.lower(F.trim(value))
    return F.coalesce(F.element_at(constant_map(table), clean), clean)


def terms_in(text: Column, terms: list[str]) -> Column:
    """Terms standing in the text as whole words, longest first, each taken out before shorter ones are looked for."""
    order = sorted(dict.fromkeys(terms), key=lambda t: (-len(t), t))
    start = F.struct(padded(text).alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, term: Column) -> Column:
        word = F.concat(F.lit(" "), term, F.lit(" "))
        hit = F.contains(state["rest"], word)
        return F.struct(F.when(hit, F.replace(state["rest"], word, F.lit("  "))).otherwise(state["rest"]).alias("rest"), F.when(hit, F.array_append(state["found"], term)).otherwise(state["found"]).alias("found"))

    return F.aggregate(constant_words(order), start, step, lambda s: s["found"])


def simplified(text: Column) -> Column:
    """Traditional characters as simplified ones, a letter for a letter."""
    return F.translate(text, "".join(TRADITIONAL), "".join(TRADITIONAL.values()))


def named_in_script(text: Column, lookup: dict[str, str]) -> Column:
    """What the words of a script without blanks stand for, left to right, the longest at each place."""
    longest = "|".join(map(re.escape, sorted(lookup, key=len, reverse=True)))
    found = F.regexp_extract_all(text, F.lit(f"({longest})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda w: F.element_at(constant_map(lookup), w)))


def contained(value: Column, lookup: dict[str, str]) -> Column:
    """The lookup's value for the trimmed, lower-case text itself, else for its longest word that the text contains, else the text."""
    clean = F.lower(F.trim(value))
    inside = F.get(F.filter(F.expr(f"array({', '.join(f'struct({quoted(w)} AS w, {quoted(v)} AS v)' for w, v in sorted(lookup.items(), key=lambda kv: -len(kv[0])))})"), lambda t: F.contains(clean, t["w"])), F.lit(0))["v"]
    return F.coalesce(F.element_at(constant_map(lookup), clean), inside, clean)
