"""Search in beats, with the places of hits in the original text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, comparable_text

C = F.col
# Signs that comparison passes over.
_SIGNS = [*b".,!?;:'\"()[]{}-", 0x2013, 0x2014, 0x2026, 0xB7, 0x2018, 0x2019, 0x2BC, 0x201C, 0x201D]
_BLANKS = [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_DROPPED = "[" + "".join(rf"\x{{{x:X}}}" for x in _SIGNS) + "]"
_UNSEEN = "[\u200b-\u200d\ufeff\u2060\u00ad]"


def needle_of(text: str) -> str:
    """What is looked for: compatibility forms unified, lower case, without signs, blanks collapsed."""
    plain = re.sub(_UNSEEN, "", unicodedata.normalize("NFKC", text)).lower()
    bare = plain.translate({x: None for x in _SIGNS})
    return re.sub("[" + "".join(map(chr, _BLANKS)) + "]+", " ", bare).strip(" ")


def normalized(text: Column) -> Column:
    """The text as it is searched: lower case, without signs, blanks collapsed. Compatibility forms stay, so that places can be told."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), _DROPPED, ""), SPACES, " "))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once although use names it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def origins(text: Column) -> Column:
    """For each character of normalized(text) the place (from 0) of the character of text that it comes from."""
    blanks, signs = (F.lit("".join(map(chr, x))) for x in (_BLANKS, _SIGNS))
    lower = F.transform(F.split(text, ""), lambda c, i: F.struct(F.lower(c).alias("c"), i.alias("i")))
    # a character whose lower case is two is two
    one = F.flatten(F.transform(lower, lambda x: F.transform(F.split(x["c"], ""), lambda c: F.struct(F.when(F.call_function("instr", blanks, c) > 0, " ").otherwise(c).alias("c"), x["i"].alias("i")))))
    seen = F.filter(one, lambda x: (x["c"] != "") & (F.call_function("instr", signs, x["c"]) == 0))
    # of blanks that follow each other, signs between them or not, the first stays; none at the ends
    single = _let(seen, lambda s: F.filter(s, lambda x, k: (x["c"] != " ") | ((k > 0) & (F.get(s, k - 1)["c"] != " "))))
    return _let(single, lambda s: F.transform(F.when(F.get(s, F.size(s) - 1)["c"] == " ", F.slice(s, 1, F.size(s) - 1)).otherwise(s), lambda x: x["i"]))


def find_match(text: Column, needle: str) -> Column:
    """struct(start, length) of the first hit in the original text, null if there is none; it reaches to the next character that is not passed over."""
    at = F.locate(needle, normalized(text))  # from 1
    span = lambda place: F.struct(F.get(place, at - 1).cast("int").alias("start"), F.greatest(F.lit(1), F.coalesce(F.get(place, at - 1 + len(needle)), F.length(text)) - F.get(place, at - 1)).cast("int").alias("length"))
    return F.when(at > 0, _let(origins(text), span))


def search(beats: DataFrame, text: str, scope: str = "all", limit: int | None = 200, language: str | None = None, all_languages: bool = False) -> DataFrame:
    """Hits in order: title_id, place, type, name, language, text, at and length (of the first hit in text, counted in characters).

    beats: title_id, place, type, name, text and, if there are any, variants (array of language and text, in the order of
    preference). Of dialogue the variant of ``language`` is searched, else the first, or with all_languages the first variant
    that has a hit; without variants it is text. scope: all, dialogue, action (whatever is not dialogue) or speaker (dialogue by
    the name; at and length are 0). Text without letters or digits finds nothing. A limit is a feature of the search: the
    first hits by title and place; None gives all.
    """
    needle = needle_of(text)
    spoken = C("type") == "dialogue"
    plain = F.array(F.struct(F.lit(None).cast("string").alias("language"), C("text").alias("text")))
    if "variants" in beats.columns:
        every = F.when(spoken & (F.size("variants") > 0), F.transform("variants", lambda v: F.struct(v["language"].alias("language"), v["text"].alias("text")))).otherwise(plain)
    else:
        every = plain
    one = F.slice(every, 1, 1)
    if language is not None:
        of = F.filter(every, lambda v: v["language"] == language)
        one = F.when(F.size(of) > 0, F.slice(of, 1, 1)).otherwise(one)
    rows = beats if scope == "all" else beats.where(~spoken if scope == "action" else spoken)
    if scope == "speaker":
        found = rows.where(F.lit(bool(needle)) & comparable_text(C("name")).contains(needle)).withColumn("_v", F.get(one, 0))
        found = found.withColumn("_m", F.struct(F.lit(0).alias("start"), F.lit(0).alias("length")))
    else:
        # the cheap test first: places are worked out for hits only
        held = F.filter(every if all_languages else one, lambda v: normalized(v["text"]).contains(needle))
        found = rows.withColumn("_v", F.get(held, 0)).where(F.lit(bool(needle)) & C("_v").isNotNull()).withColumn("_m", find_match(C("_v.text"), needle))
    out = found.select("title_id", "place", "type", "name", C("_v.language").alias("language"), C("_v.text").alias("text"), C("_m.start").alias("at"), C("_m.length").alias("length"))
    return out if limit is None else out.orderBy("title_id", "place").limit(limit)
