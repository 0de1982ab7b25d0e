"""Labels with structure: quality tiers, settings, phrases for enumerated kinds."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of resolutions (a number and a word, or words), words of tiers.
RESOLUTIONS = (("8 k", 4320), ("4 k", 2160), ("uhd", 2160), ("quad hd", 1440), ("quadhd", 1440), ("qhd", 1440), ("full hd", 1080), ("fullhd", 1080), ("fhd", 1080), ("hd", 720))
ENHANCED = ("premium", "enhanced bitrate", "higher bitrate", "프리미엄", "プレミアム")
HDR = ("hdr", "dolby vision")
AUTO = ("auto", "automatic", "자동", "自動", "автоматически")
# Phrases.
SOURCES = {
    "subtitle": "Subtitle", "audio-asr": "Audio ASR", "audio-speaker": "Speaker", "audio-event": "Sound", "audio-silence": "Silence",
    "video": "Video", "ocr": "On-screen text", "playback": "Playback", "metadata": "Metadata", "user": "User correction",
}
SOUNDS = {
    "door": "A door opens.", "knock": "A knock at the door.", "footsteps": "Footsteps approach.", "phone": "A phone rings.", "alarm": "An alarm sounds.",
    "glass": "Glass breaks.", "gunshot": "A gunshot cracks.", "vehicle": "A vehicle passes.", "laughter": "Laughter.", "applause": "Applause.",
    "impact": "A sharp impact.", "music-start": "Music begins.", "music-end": "The music fades.", "music-swell": "The music swells.",
    "ambience-change": "The ambience shifts.", "unclassified": "A sudden sound.",
}
# Words of headings (interior, exterior, unknown time, times of day).
HEADINGS = {
    "en": ("INT.", "EXT.", "UNKNOWN TIME", {}),
    "ko": ("실내.", "실외.", "시간 불명", {"DAY": "낮", "NIGHT": "밤", "DAWN": "새벽", "DUSK": "해질녘", "MORNING": "아침", "EVENING": "저녁"}),
    "ja": ("屋内.", "屋外.", "時間不明", {"DAY": "昼", "NIGHT": "夜", "DAWN": "夜明け", "DUSK": "夕暮れ", "MORNING": "朝", "EVENING": "夕方"}),
    "es": ("INT.", "EXT.", "HORA DESCONOCIDA", {"DAY": "DÍA", "NIGHT": "NOCHE", "DAWN": "AMANECER", "DUSK": "ANOCHECER", "MORNING": "MAÑANA", "EVENING": "TARDE"}),
}
TIMES = ("day", "night", "dawn", "dusk", "morning", "afternoon", "evening", "sunset", "sunrise")
# Words that tell interiors and exteriors, and those of them that are mere markers.
INSIDE = ("int", "interior", "indoor", "indoors", "inside")
OUTSIDE = ("ext", "exterior", "outdoor", "outdoors", "outside", "street", "park", "forest", "beach")
MARKERS = ("int", "ext", "interior", "exterior")


def lookup(c: Column, values: dict, default: Column | None = None) -> Column:
    """values[c]; a short when-chain, so it stays in generated code."""
    out = default if default is not None else F.lit(None)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def parse_quality(label: Column) -> Column:
    """struct(resolution, frame_rate, enhanced, hdr, auto); an automatic tier has no resolution of its own.

    A label is read as a row of numbers and words: 1080 p 60, 1920 x 1080, 50 fps, full hd.
    """
    low = F.lower(label)
    tokens = F.regexp_extract_all(low, F.lit("[0-9]+|[a-z]+|×"), F.lit(0))
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))

    def number(pattern: str, group: int = 1) -> Column:
        found = F.regexp_extract(line, pattern, group)
        return F.when(found != "", found.cast("int"))

    # names in Latin letters are whole words, others parts of the label
    says = lambda names: reduce(or_, ((line.contains(f" {x} ") if x.isascii() else low.contains(x)) for x in names))
    named = F.coalesce(*[F.when(line.contains(f" {name} "), lines) for name, lines in RESOLUTIONS])
    resolution = F.coalesce(number(" ([0-9]{3,4}) p "), number(" [0-9]{3,4} [x×] ([0-9]{3,4}) "), named)
    rates = number(" [0-9]{3,4} p ([0-9]{2,3}) "), number(" ([0-9]{2,3}) (fps|hz) ")
    rate = F.coalesce(*[F.when(r.between(20, 240), r) for r in rates])
    auto = says(AUTO)
    return F.struct(F.when(~auto, resolution).alias("resolution"), rate.alias("frame_rate"), says(ENHANCED).alias("enhanced"), says(HDR).alias("hdr"), auto.alias("auto"))


def describe_quality(resolution: Column, enhanced: Column, hdr: Column, frame_rate: Column) -> Column:
    return F.concat_ws(" ", F.when(resolution.isNotNull(), F.concat(resolution.cast("string"), F.lit("p"))).otherwise("Unknown"), F.when(frame_rate > 30, F.concat(frame_rate.cast("string"), F.lit("fps"))), F.when(hdr, "HDR"), F.when(enhanced, "enhanced bitrate"))


def parse_setting(c: Column) -> Column:
    """struct(place, int_ext, time_of_day) of a setting's description: its words are looked up; a marker goes from the front, a time from the end."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    holds = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    kind = F.when(holds(INSIDE), "INT").when(holds(OUTSIDE), "EXT")
    when = F.upper(F.get(F.filter(words, lambda w: w.isin(*TIMES)), 0))
    whole = F.trim(c)
    bare = lambda x: F.regexp_replace(F.lower(x), r"\.$", "")
    head, tail = r"(?s)^([^\s,:-]+)[\s,:-]+(.*)$", r"(?s)^(.*?)[\s,-]+([^\s,-]+)$"
    whole = F.when(bare(F.regexp_extract(whole, head, 1)).isin(*MARKERS), F.regexp_extract(whole, head, 2)).otherwise(whole)
    whole = F.when(bare(F.regexp_extract(whole, tail, 2)).isin(*TIMES), F.regexp_extract(whole, tail, 1)).otherwise(whole)
    return F.struct(F.trim(F.regexp_replace(whole, r"\s+", " ")).alias("place"), kind.alias("int_ext"), when.alias("time_of_day"))


def scene_heading(place: Column, int_ext: Column, time_of_day: Column, language: Column) -> Column:
    """Localized heading; null without a place; languages without words of their own use English."""
    base = F.element_at(F.split(language, "-"), 1)
    key = F.when(language.isin(*HEADINGS), language).when(base.isin(*HEADINGS), base).otherwise("en")
    inside, outside, unknown = (lookup(key, {k: v[i] for k, v in HEADINGS.items()}) for i in range(3))
    time = F.lit(None).cast("string")
    for lang, (_, _, _, names) in HEADINGS.items():
        for name, word in names.items():
            time = F.when((key == lang) & (time_of_day == name), word).otherwise(time)
    time = F.coalesce(time, time_of_day, unknown)
    prefix = F.when(int_ext == "INT", inside).when(int_ext == "EXT", outside)
    return F.when(F.coalesce(place, F.lit("")) != "", F.trim(F.regexp_replace(F.concat_ws(" ", prefix, F.upper(F.trim(place)), F.lit("-"), time), r"\s+", " ")))


def describe_sources(sources: Column) -> Column:
    said = F.array_join(F.transform(sources, lambda s: lookup(s, SOURCES)), " + ")
    return F.when(said == "", "No source").otherwise(said)


def describe_silence(ms: Column) -> Column:
    return F.when(ms >= 8000, "A long silence.").when(ms >= 4000, "Silence.").otherwise("A pause.")


def describe_sound(kind: Column, description: Column) -> Column:
    return F.coalesce(F.when(description != "", description), lookup(kind, SOUNDS))


def pick_variant(variants: Column, order: Column, language: Column, fallbacks: list[str]) -> Column:
    """Of a map language → struct(text, origin): the language, the fallbacks in turn, a subtitle, a transcript, the first in order."""
    listed = F.transform(order, lambda k: F.element_at(variants, k))
    of = lambda origin: F.get(F.filter(listed, lambda v: v["origin"] == origin), 0)
    return F.coalesce(F.try_element_at(variants, language), *[F.try_element_at(variants, F.lit(f)) for f in fallbacks], of("platform-subtitle"), of("audio-asr"), F.get(listed, 0))


def classify_onset(prominence: Column, attack: Column, centroid: Column, flatness: Column) -> Column:
    """Three kinds are told by their form; the rest stays unclassified."""
    return (
        F.when((attack > 0.5) & (flatness > 0.4) & (prominence > 18), "impact")
        .when((flatness < 0.1) & (centroid > 700) & (centroid < 4000) & (attack < 0.35), "alarm")
        .when((flatness > 0.6) & (attack < 0.3) & (prominence > 12), "applause")
        .otherwise("unclassified")
    )
