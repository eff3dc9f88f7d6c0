"""Understanding what a person asks and answers: free text to fields, as Column expressions.

Only typing errors are told by Python (difflib's ratio), in Arrow batches, and only for
texts in which no known word was found.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .once import constant_map, constant_words, quoted
from .text import COLOR_ALIASES, COLORS, named_in_script, padded, simplified
from .words import COLORS_CJK, GREETINGS_ZH, JOINERS, LANGUAGES, MATERIALS, MISSPELLED, NAMES, OBJECTS, OBJECTS_CJK, RELATIONS_EN, SENTENCES, SIZES

# fixed values: spellings that are put right first, in this order
REWRITES = {"w/": " with ", "w/o": " without ", "next 2": " next to ", "nxt to": " next to ", "besids": " beside ", "besid": " beside ", "nearby": " near "}
# fixed values: openings of a request
FILLERS = [
    "where is", "where's", "where did i put", "find", "find me", "look for", "locate", "is there", "do you see", "i lost", "i left", "i misplaced",
    "can you find", "please find", "show me", "help me find", "busca", "encuentra", "cherche", "trouve", "찾아", "어디",
]
ARTICLES = [" my ", " the ", " a ", " an ", " that ", " this "]
# fixed values: relation phrases
PHRASES = {
    "beside": "beside", "next to": "beside", "by": "beside", "alongside": "beside", "adjacent to": "beside", "besids": "beside",
    "near": "near", "close to": "near", "around": "near", "nearest": "near", "closest to": "near", "cerca de": "near", "cerca del": "near",
    "on": "on", "on top of": "on", "atop": "on", "under": "below", "underneath": "below", "below": "below", "beneath": "below",
    "above": "above", "over": "above", "left of": "left_of", "to the left of": "left_of", "right of": "right_of", "to the right of": "right_of",
    "in": "inside", "inside": "inside", "within": "inside", "overlapping": "overlapping", "overlaps": "overlapping", "touching": "overlapping",
    "same surface as": "same_surface", "on the same surface as": "same_surface", "same table as": "same_surface", "on the same table as": "same_surface",
    "same desk as": "same_surface", "on the same desk as": "same_surface", "behind": "near", "in front of": "near",
}
# fixed values: marks of "not this one", before and after a name
NOT_BEFORE = ["not ", "no ", "isn't ", "is not ", "wasn't ", "was not ", "instead of ", "rather than ", "不是", "不"]
NOT_AFTER = ["말고", "아니라", "아니고", "이 아니", "가 아니"]
# fixed values: words of "all of them"
ALL_WORDS = r"(?iU)\b(all|every|each|everything|list|show me the)\b"
ALL_PARTS = ["모두", "모든", "전부", "전체", "다 보여", "다보여", "목록", "리스트", "나열", "全部", "所有", "都有", "列出", "列表", "有哪些", "哪些"]
# fixed values: places in a shown list, -1 the last
POSITIONS = {
    "first": 0, "1st": 0, "left": 0, "leftmost": 0, "첫": 0, "첫번째": 0, "왼쪽": 0, "왼": 0, "제일왼쪽": 0, "第一": 0, "左边": 0, "左": 0, "最左": 0,
    "second": 1, "2nd": 1, "middle": 1, "centre": 1, "center": 1, "두번째": 1, "가운데": 1, "중간": 1, "第二": 1, "中间": 1,
    "third": 2, "3rd": 2, "세번째": 2, "세": 2, "第三": 2, "fourth": 3, "4th": 3, "네번째": 3, "第四": 3,
    "last": -1, "right": -1, "rightmost": -1, "마지막": -1, "오른쪽": -1, "오른": -1, "제일오른쪽": -1, "最后": -1, "右边": -1, "右": -1, "最右": -1,
}
COUNTERS = ["no", "number", "num", "번", "번째", "개", "번호", "第", "个", "번쨰"]
ORDINALS = ["first", "second", "third", "fourth"]
NONE_OF = ["none", "neither", "no ", "없", "아니"]
# fixed values: endings that aren't part of an answer's word
ENDINGS = ["색", "色", "的", "이야", "예요", "요", "인데", "거", "것", "이", "가", "은", "는"]
# fixed values: greetings that wake by themselves as the first word
GREETINGS = ["헤이", "해이", "혜이", "헤에이", "헤이요", "하이", "에이", "예이", "안녕", "여보세요", "hey", "heyy", "hei", "hay", "hi", "hiya", "hello", "yo"]
#: Hangul and Han.
CJK = r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7A3}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"

def _words(values) -> Column:
    return constant_words(values)


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _longest(values) -> list[str]:
    return sorted(values, key=len, reverse=True)


def _table(pairs: dict) -> Column:
    return constant_map(pairs)


def _any(text: Column, parts: list[str]) -> Column:
    return F.exists(_words(parts), lambda p: F.contains(text, p))


def squashed(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def normal(text: Column) -> Column:
    """Trimmed lower case with known misspellings put right; null is empty."""
    out = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    for old, new in REWRITES.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def without_filler(text: Column) -> Column:
    """Without the longest opening, then without articles between words."""
    opening = F.get(F.filter(_words(_longest(FILLERS)), lambda p: F.startswith(text, p)), F.lit(0))
    out = F.when(opening.isNull(), text).otherwise(F.btrim(F.substr(text, F.length(opening) + 1), F.lit(" ?!.,")))
    for word in ARTICLES:
        out = F.replace(out, F.lit(word), F.lit(" "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def relation_phrase(text: Column) -> Column:
    """The longest relation phrase in the text as whole words, else null."""
    phrases = _words(f" {p} " for p in _longest(PHRASES))
    return F.btrim(_let(padded(text), lambda own: F.get(F.filter(phrases, lambda p: F.contains(own, p)), F.lit(0))))


def split_at(text: Column, phrase: Column) -> Column:
    """What stands left and right of the phrase as a word of its own; all is left where it doesn't stand."""
    own = F.concat(F.lit(" "), text, F.lit(" "))
    at = F.coalesce(F.position(F.concat(F.lit(" "), phrase, F.lit(" ")), own), F.lit(0))
    cut = F.struct(F.trim(F.substr(own, F.lit(1), at - 1)).alias("left"), F.trim(F.substr(own, at + F.length(phrase) + 2)).alias("right"))
    return F.when(at > 0, cut).otherwise(F.struct(text.alias("left"), F.lit("").alias("right")))


def spoken_names(text: Column, lookup: dict[str, str], plural: bool = True) -> Column:
    """struct(found, rest): what the known words in the text stand for, longest word first; each is taken out before shorter ones are looked for.

    Taking words out makes no new words, so only terms whose first word begins one of the
    text's are looked for.
    """
    endings = ["", "s"] if plural else [""]
    head = lambda w: " " + w.strip(" ").split(" ")[0]
    terms = F.expr(f"array({', '.join(f'struct({quoted(w)} AS w, {quoted(lookup[w])} AS v, {quoted(head(w))} AS h)' for w in _longest(lookup))})")
    start = lambda own: F.struct(own.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, term: Column) -> Column:
        forms = [F.concat(F.lit(" "), term["w"], F.lit(e + " ")) for e in endings]
        rest, hit = state["rest"], F.lit(False)
        for form in forms:
            hit = hit | F.contains(state["rest"], form)
            rest = F.replace(rest, form, F.lit(" "))
        found = F.when(hit, F.array_distinct(F.array_append(state["found"], term["v"]))).otherwise(state["found"])
        return F.struct(rest.alias("rest"), found.alias("found"))

    return _let(padded(text), lambda own: F.aggregate(F.filter(terms, lambda t: F.contains(own, t["h"])), start(own), step))


def nearly(lookup: dict[str, str]):
    """Pandas UDF on arrays of words: what each word of five letters or more nearly spells, the likeliest known word alone counting, lengths at most one apart."""
    known = [w for w in lookup if " " not in w]

    @F.pandas_udf("array<string>")
    def near(rows: pd.Series) -> pd.Series:
        seen: dict[str, str | None] = {}

        def one(word):
            if word not in seen:
                best = difflib.get_close_matches(word, known, n=1, cutoff=0.84) if len(word) >= 5 else []
                told = lookup[best[0]] if best and abs(len(best[0]) - len(word)) <= 1 else None
                if len(seen) >= 100_000:
                    return told
                seen[word] = told
            return seen[word]

        return rows.map(lambda ws: None if ws is None else list(dict.fromkeys(v for v in map(one, ws) if v)))

    return near


def _tokens(rest: Column) -> Column:
    return F.filter(F.split(F.trim(rest), " "), lambda w: w != "")


def with_types(df: DataFrame, text: str, out: str, synonyms: dict[str, list[str]], cjk: dict[str, list[str]] | None = None) -> DataFrame:
    """``out``: the object types the text names - in Korean or Chinese, else as words, else within one run-on word, else nearly spelled."""
    lookup = {w.lower(): t for t, ws in synonyms.items() for w in ws}
    lookup |= {w: t for w, t in MISSPELLED.items() if t in synonyms}
    df = df.withColumn("_s", spoken_names(F.col(text), lookup))
    token = F.trim(F.col("_s.rest"))
    inside = F.filter(_words([w for w in _longest(lookup) if len(w) >= 5]), lambda w: F.contains(token, w))
    run_on = F.when((F.length(token) > 6) & ~F.contains(token, F.lit(" ")) & (F.size(inside) > 0), F.array(F.element_at(_table(lookup), F.get(inside, F.lit(0)))))
    found = F.when(F.size("_s.found") > 0, F.col("_s.found")).otherwise(run_on)
    if cjk:
        own = named_in_script(simplified(F.col(text)), {w: t for t, ws in cjk.items() for w in ws})
        found = F.when(F.col(text).rlike(CJK) & (F.size(own) > 0), own).otherwise(found)
    df = df.withColumn("_f", found)
    guess = nearly(lookup)(F.when(F.col("_f").isNull(), _tokens(F.col("_s.rest"))))
    return df.withColumn(out, F.coalesce("_f", guess, F.array().cast("array<string>"))).drop("_s", "_f")


def with_colors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: the colours the text names in Korean or Chinese, else in English, then those it nearly spells."""
    lookup = {**COLOR_ALIASES, **{c: c for c in COLORS}}
    df = df.withColumn("_s", spoken_names(F.col(text), lookup, plural=False)).withColumn("_k", F.when(F.col(text).rlike(CJK), named_in_script(simplified(F.col(text)), COLORS_CJK)))
    df = df.withColumn("_k", F.when(F.size("_k") > 0, F.col("_k")))
    guess = nearly({c: c for c in COLORS})(F.when(F.col("_k").isNull(), _tokens(F.col("_s.rest"))))
    return df.withColumn(out, F.coalesce("_k", F.array_distinct(F.concat("_s.found", guess)), F.array().cast("array<string>"))).drop("_s", "_k")


def without_negated(text: Column, types: Column, synonyms: dict[str, list[str]]) -> Column:
    """Of two types or more, those not denied close by, in the order of the text; all where every one is denied."""
    arrays = (f"{quoted(t)}, array({', '.join(map(quoted, [*ws, t]))})" for t, ws in synonyms.items())
    words = F.expr(f"map({', '.join(arrays)})")
    first = lambda t: F.array_min(F.filter(F.transform(F.element_at(words, t), lambda w: F.position(w, text)), lambda at: at > 0))
    placed = F.transform(types, lambda t: F.struct(first(t).alias("at"), t.alias("t")))

    def denied(p: Column) -> Column:
        begin = F.greatest(F.lit(1), p["at"] - 14)
        return _any(F.substr(text, begin, p["at"] - begin), NOT_BEFORE) | _any(F.substr(text, p["at"], F.lit(18)), NOT_AFTER)

    seen = F.array_sort(F.filter(placed, lambda p: p["at"].isNotNull() & ~denied(p)))
    kept = F.transform(F.concat(seen, F.filter(placed, lambda p: p["at"].isNull())), lambda p: p["t"])
    return F.when((F.size(types) < 2) | (F.size(kept) == 0), types).otherwise(kept)


#: A number at the beginning with the word for floor or room behind it, in any of the languages.
FLOOR = re.compile(r"^\s*\d+\s*(?:f|楼|층의|층|호실)?\s*", re.I)


def place_names(name: str, spoken: list[str] = ()) -> list[str]:
    """Squashed forms under which people speak of a place: its name, its parts, its spoken names with the floor and without."""
    bare = lambda s: "".join(c for c in s.lower() if c.isalnum())
    parts = [bare(p) for p in re.split("[-_]", name)]
    forms = [bare(name), *[p for p in parts if len(p) >= 3 and not re.fullmatch(r"\d+f|b\d", p)]]
    for s in spoken:
        rest = bare(FLOOR.sub("", s))
        forms += [bare(s), *([rest] if len(rest) >= 3 else [])]
    return [f for f in dict.fromkeys(forms) if len(f) >= 2]


def place_in(text: Column, places: dict[str, list[str]]) -> Column:
    """The place (name -> spoken names) whose longest form the text holds; the first of equals."""
    forms = [(f, name) for name, spoken in places.items() for f in place_names(name, spoken)]
    forms.sort(key=lambda p: -len(p[0]))
    if not forms:
        return F.lit(None).cast("string")
    listed = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(n).alias("n")) for f, n in forms])
    return _let(squashed(simplified(text)), lambda own: F.get(F.filter(listed, lambda p: F.contains(own, p["f"])), F.lit(0))["n"])


def _once_a_text(df: DataFrame, text: str, make) -> DataFrame:
    """df with the columns that ``make`` adds to a table of its different texts: what is said is understood once, however many say it. A stream's rows are taken one by one."""
    if df.isStreaming:
        return make(df.withColumn("_said", F.coalesce(text, F.lit("")))).drop("_said")
    told = make(df.select(F.coalesce(text, F.lit("")).alias("_said")).distinct()).withColumnRenamed("_said", "_key")
    return df.join(told, F.coalesce(df[text], F.lit("")) == F.col("_key")).drop("_key")


def parse(df: DataFrame, text: str = "text", places: dict[str, list[str]] | None = None, synonyms: dict[str, list[str]] | None = None, cjk: dict[str, list[str]] | None = OBJECTS_CJK) -> DataFrame:
    """Adds target_type, color, predicate, anchor_type and location of the request in ``text`` (null: all null)."""
    return _once_a_text(df, text, lambda texts: _parsed(texts, "_said", places, synonyms, cjk))


def _parsed(df: DataFrame, text: str, places: dict[str, list[str]] | None, synonyms: dict[str, list[str]] | None, cjk: dict[str, list[str]] | None) -> DataFrame:
    """``parse`` of every row."""
    synonyms, at = synonyms or OBJECTS, lambda c, i: F.get(F.col(c), F.lit(i))
    spellings = {t: [*synonyms.get(t, []), *(cjk or {}).get(t, [])] for t in dict.fromkeys([*synonyms, *(cjk or {})])}
    df = df.withColumn("_n", normal(F.col(text))).withColumn("_p", relation_phrase(F.col("_n"))).withColumn("_cut", split_at(F.col("_n"), F.col("_p")))
    df = df.withColumns({"_l": without_filler(F.col("_cut.left")), "_r": without_filler(F.col("_cut.right"))})
    for side, out in (("_l", "_lt"), ("_r", "_rt"), ("_n", "_at")):
        df = with_types(df, side, out, synonyms, cjk).withColumn(out, without_negated(simplified(F.col(side)), F.col(out), spellings))
    df = df.withColumn("_c", F.when(F.col("_p").isNull(), F.col("_n")).otherwise(F.col("_l")))
    df = with_colors(df, "_c", "_cs")
    df = df.withColumn("target_type", F.coalesce(at("_lt", 0), at("_at", 0)))
    again = at("_rt", 0).eqNullSafe(F.col("target_type"))
    alone = F.when(F.size("_lt") > 0, at("_rt", 0))  # a single name may serve as both only with a target on the left
    df = df.withColumn("anchor_type", F.when(again, F.coalesce(at("_rt", 1), alone)).otherwise(at("_rt", 0)))
    df = df.withColumns({"color": at("_cs", 0), "predicate": F.when(F.col("anchor_type").isNotNull(), F.element_at(_table(PHRASES), F.col("_p"))), "location": place_in(F.col(text), places or {})})
    return df.drop("_n", "_p", "_cut", "_l", "_r", "_lt", "_rt", "_at", "_c", "_cs")


# ---------------------------------------------------------------- answers


def wants_all(text: Column) -> Column:
    own = simplified(F.coalesce(text, F.lit("")))
    return own.rlike(ALL_WORDS) | _any(own, ALL_PARTS)


def position(text: Column, count: Column) -> Column:
    """0-based place in a list of ``count`` that the answer points at - by a bare number, an order or a side - else null."""
    raw = F.lower(F.trim(text))
    number = F.regexp_extract(raw, r"\d+", 0).try_cast("long") - 1
    letters = F.regexp_replace(raw, r"[^\p{L}]", "")
    counted = number.isNotNull() & ((letters == "") | letters.isin(COUNTERS)) & (number >= 0) & (number < count)
    own = squashed(simplified(text))
    word = F.get(F.filter(_words(_longest(POSITIONS)), lambda w: F.contains(own, w)), F.lit(0))
    told = F.element_at(_table(POSITIONS), word).cast("long")
    told = F.when(told < 0, count + told).otherwise(told)
    return F.when(counted, number).when((told >= 0) & (told < count), told)


def shortlist_pick(text: Column, count: Column) -> Column:
    """0-based place picked from a shortlist; -1 for none of them; null for neither."""
    own = F.lower(F.trim(text))
    none = F.exists(_words(NONE_OF), lambda p: F.startswith(own, p))
    number = F.regexp_extract(own, r"\d+", 0).try_cast("long") - 1
    listed = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).cast("long").alias("i")) for i, w in enumerate(ORDINALS)])
    word = F.get(F.filter(listed, lambda p: F.contains(own, p["w"]) & (p["i"] < count)), F.lit(0))["i"]
    return F.when(none, F.lit(-1).cast("long")).when(own.rlike(r"\d"), F.when((number >= 0) & (number < count), number)).otherwise(word)


def stem(word: Column) -> Column:
    """The squashed word without endings, two letters at least staying."""
    return F.regexp_replace(squashed(word), "^(.{2,}?)(?:" + "|".join(ENDINGS) + ")+$", "$1")


def option_answered(text: Column, options: Column) -> Column:
    """Of options (array of struct(option, name)), that whose name, whole or as a stem, is the longest in the answer; the first of equals."""
    own = squashed(simplified(text))
    forms = F.flatten(F.transform(options, lambda o: F.array(F.struct(squashed(o["name"]).alias("f"), o["option"].alias("o")), F.struct(stem(o["name"]).alias("f"), o["option"].alias("o")))))
    held = F.filter(forms, lambda p: (p["f"] != "") & F.contains(own, p["f"]))
    longest = F.array_max(F.transform(held, lambda p: F.length(p["f"])))
    return F.get(F.filter(held, lambda p: F.length(p["f"]) == longest), F.lit(0))["o"]


def spoken_form(text: Column, limit: int = 200) -> Column:
    """The first line, cut at the end of a sentence in its second half, else with dots, where it is longer than ``limit``."""
    first = F.trim(F.split(F.trim(F.coalesce(text, F.lit(""))), "\n")[0])
    cut = F.substr(first, F.lit(1), F.lit(limit))
    out = F.concat(F.rtrim(cut), F.lit("..."))
    for mark in ("？", "。", "! ", "? ", ". "):
        back = F.position(F.lit(mark[::-1]), F.reverse(cut))
        at = F.lit(limit) - back - len(mark) + 1
        out = F.when((back > 0) & (at > limit // 2), F.trim(F.substr(cut, F.lit(1), at + len(mark)))).otherwise(out)
    return F.when(F.length(first) <= limit, first).otherwise(out)


def wake_word(text: Column, names: list[str]) -> Column:
    """struct(heard, rest): whether a name is called, in any spacing, or a greeting opens the text; and what follows it."""
    clean = lambda c: F.regexp_replace(c, r"^[ ,.!?~\-·、，。！？]+|\s+$", "")
    known = _words(_longest(dict.fromkeys("".join(c for c in n.lower() if c.isalnum()) for n in names)))
    called = lambda own: F.get(F.filter(known, lambda n: F.contains(own, n)), F.lit(0))

    def named(raw: Column, name: Column) -> Column:
        spaced = F.array_join(F.filter(F.split(name, ""), lambda c: c != ""), r"[^\p{L}\p{N}]*")
        return F.struct(F.lit(True).alias("heard"), clean(F.regexp_replace(raw, F.concat(F.lit("(?isu)^.*?"), spaced), F.lit(""))).alias("rest"))

    def greeted(bare: Column) -> Column:
        opening = F.regexp_extract(bare, r"^\S*", 0)
        long, short = F.btrim(F.lower(opening), F.lit(",.!?~-·，。！？")).isin(GREETINGS), F.substring(bare, 1, 1).isin(*GREETINGS_ZH)
        rest = F.when(short, clean(F.substr(bare, F.lit(2)))).when(long, clean(F.substr(bare, F.length(opening) + 1))).otherwise("")
        return F.struct((short | long).alias("heard"), rest.alias("rest"))

    def heard(raw: Column) -> Column:
        return _let(_let(squashed(raw), called), lambda name: F.when(name.isNotNull(), named(raw, name)).otherwise(_let(F.regexp_replace(raw, "^[\\s\"'“”‘’(（]+", ""), greeted)))

    return _let(simplified(F.coalesce(text, F.lit(""))), heard)


def with_request(df: DataFrame, rest: str, out: str, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """``out``: whether what follows a wake word asks for something - it names a thing or a colour, or has four letters."""
    df = with_colors(with_types(df, rest, "_t", synonyms or OBJECTS, OBJECTS_CJK), rest, "_c")
    return df.withColumn(out, (F.size("_t") > 0) | (F.size("_c") > 0) | (F.length(F.trim(rest)) >= 4)).drop("_t", "_c")


# ---------------------------------------------------------------- replies


def ends_closed(word: Column) -> Column:
    """Whether the last Hangul syllable, letter or digit is spoken with a consonant at its end."""
    last = F.regexp_extract(word, r"([\p{L}\p{N}])[^\p{L}\p{N}]*$", 1)
    code = F.when(last.rlike(r"^[\x{AC00}-\x{D7A3}]$"), F.conv(F.hex(F.encode(last, "UTF-16BE")), 16, 10).cast("int"))
    return F.coalesce((code - 0xAC00) % 28 != 0, F.lower(last).isin(list("0136780lmnr")))


def particle(word: Column, closed: str, opened: str) -> Column:
    return F.when(ends_closed(word), closed).otherwise(opened)


def place_text(location: Column, predicate: Column, anchor: Column) -> Column:
    """Where something is, from stored relations; relations of the picture alone are said to be so."""
    verb = F.when(predicate == "on", "on top of").otherwise(F.replace(predicate, F.lit("_"), F.lit(" ")))
    shown = F.when(predicate.isin("left_of", "right_of", "above", "below"), " in this photo").otherwise("")
    where = F.concat(F.lit("in the "), location)
    return F.coalesce(F.concat(where, F.lit(", "), verb, F.lit(" the "), anchor, shown), where)


def summary(*parts: Column, most: int = 5) -> Column:
    """Different non-empty parts in order, ``most`` at the most."""
    return F.array_join(F.slice(F.array_distinct(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))), 1, most), ", ")


def question(prompt: Column, options: Column, count: Column) -> Column:
    """A question about ``count`` candidates with its choices; one choice alone is confirmed."""
    found = F.concat(F.lit("I found "), count.cast("string"), F.lit(" possible matches. "))
    one = F.concat(F.lit("Was it the one with "), F.get(options, F.lit(0)), F.lit("?"))
    return F.concat(found, F.when(F.size(options) == 1, one).otherwise(F.concat(prompt, F.lit(" ("), F.array_join(options, " or "), F.lit(")"))))


# ---------------------------------------------------------------- replies in three languages


def name_of(key: str, value: Column, lang: Column) -> Column:
    """What a language calls a type, colour, material, size, location or relation; the value itself where it has no word."""
    table = F.create_map(*[F.lit(x) for word, said in NAMES[key].items() for i, one in enumerate(said) for x in (f"{LANGUAGES[i + 1]}:{word}", one)])
    own = F.element_at(table, F.concat(lang, F.lit(":"), F.lower(value)))
    plain = F.coalesce(F.element_at(_table(RELATIONS_EN), value), F.replace(value, F.lit("_"), F.lit(" "))) if key == "relation" else value
    return F.coalesce(own, plain)


def sentence(key: str, lang: Column, **values: Column) -> Column:
    """A reply's sentence with its values put in, Korean particles by the sound of ``what``."""
    out = _by_language(lang, SENTENCES[key])
    if "what" in values:
        values = values | {"i": F.when(lang == "ko", particle(values["what"], "이", "가")).otherwise(""), "eul": F.when(lang == "ko", particle(values["what"], "을", "를")).otherwise("")}
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def _by_language(lang: Column, said: tuple[str, str, str]) -> Column:
    return F.when(lang == "ko", said[1]).when(lang == "zh", said[2]).otherwise(said[0])


def object_text(color: Column, kind: Column, lang: Column) -> Column:
    """Colour and type in a language, without a blank in Chinese."""
    parts = F.filter(F.array(name_of("color", color, lang), name_of("type", kind, lang)), lambda p: p.isNotNull() & (p != ""))
    return F.when(lang == "zh", F.array_join(parts, "")).otherwise(F.array_join(parts, " "))


def choices(key: str, values: Column, lang: Column) -> Column:
    """Options of a question in a language, with its word for or."""
    named = F.transform(values, lambda v: name_of("type" if key == "near" else key, v, lang))
    return F.when(lang == "ko", F.array_join(named, JOINERS[1])).when(lang == "zh", F.array_join(named, JOINERS[2])).otherwise(F.array_join(values, JOINERS[0]))


def place_said(location: Column, predicate: Column, anchor: Column, lang: Column) -> Column:
    """Where something is, in a language; relations of the picture alone are said to be so."""
    where, what, how = name_of("location", location, lang), name_of("type", anchor, lang), name_of("relation", predicate, lang)
    shown = predicate.isin("left_of", "right_of", "above", "below")
    note = lambda text: F.when(shown, text).otherwise("")
    en = F.coalesce(F.concat(F.lit("in the "), where, F.lit(", "), how, F.lit(" the "), anchor, note(" in this photo")), F.concat(F.lit("in the "), where))
    ko = F.coalesce(F.concat(where, F.lit("에서 "), what, F.lit(" "), how, note(" (이 사진 기준)")), F.concat(where, F.lit("에")))
    zh = F.coalesce(F.concat(where, what, how, note("（以这张照片为准）")), where)
    return F.when(lang == "ko", ko).when(lang == "zh", zh).otherwise(en)


# ---------------------------------------------------------------- all that a turn may mean

# fixed values: openings of a new question, answers without knowledge, yes and no
OPENERS = ["where", "find", "is there", "show", "which", "what about", "어디", "찾아"]
UNKNOWING = ["i don't know", "dont know", "no idea", "not sure", "idk", "몰라", "모르겠어", ""]
YES_SINGLE, YES_SURE = ["y", "yeah", "yep", "그", "네", "응", "맞"], ["y", "yeah", "yep", "yes", "correct", "that's it", "그", "네", "응", "맞"]
NO = ["n", "nope", "아니", "없"]


def understood(df: DataFrame, text: str = "text", places: dict[str, list[str]] | None = None, synonyms: dict[str, list[str]] | None = None, cjk: dict[str, list[str]] | None = OBJECTS_CJK) -> DataFrame:
    """Adds ``said``: a struct of everything a conversation may want to know of a turn."""
    return _once_a_text(df, text, lambda texts: _understood(texts, "_said", places, synonyms, cjk))


def _understood(df: DataFrame, text: str, places: dict[str, list[str]] | None, synonyms: dict[str, list[str]] | None, cjk: dict[str, list[str]] | None) -> DataFrame:
    """``understood`` of every row."""
    kept = df.columns
    df = _parsed(df, text, places, synonyms, cjk)
    df = with_colors(with_types(df, text, "_types", synonyms or OBJECTS, cjk), text, "_colors")
    low = F.lower(F.trim(text))
    words = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    one_of = lambda options: F.get(F.filter(_words(options), lambda w: F.array_contains(words, w)), F.lit(0))
    begins = lambda options: F.exists(_words(options), lambda w: F.startswith(low, w))
    phrase = relation_phrase(F.col(text))
    said = F.struct(
        low.alias("low"), "target_type", "color", "predicate", "anchor_type", "location", F.col("_types").alias("types"), F.col("_colors").alias("colors"), phrase.alias("phrase"), F.element_at(_table(PHRASES), phrase).alias("relation"),
        one_of(SIZES).alias("size"), one_of([m for m in MATERIALS if m != "unknown"]).alias("material"), begins(OPENERS).alias("opens"), wants_all(F.col(text)).alias("all"), low.isin(*UNKNOWING).alias("unknowing"),
        begins(YES_SINGLE).alias("yes"), begins(YES_SURE).alias("sure"), begins(NO).alias("no"), begins(NONE_OF).alias("none"), F.regexp_extract(low, r"\d+", 0).try_cast("long").alias("number"), low.rlike(r"\d").alias("digits"),
    )
    return df.select(*kept, said.alias("said"))
