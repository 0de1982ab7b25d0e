"""Provider requests and what comes back: context of windows, validated results, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import best_overlap, first_open, top_before

C = F.col
#: Shape of a window's analysis.
ANALYSIS = """struct<actions: array<struct<offset_ms: long, description: string, participants: array<string>, confidence: string>>,
 characters: array<struct<label: string, present: boolean, enters: boolean, exits: boolean, expression: string>>, setting_changes: array<struct<description: string, int_ext: string, time_of_day: string, confidence: string>>,
 text: array<struct<text: string, offset_ms: long>>, uncertainties: array<string>>""".replace("\n", "")


def dialogue_in_window(windows: DataFrame, lines: DataFrame, bucket_ms: int, lead_ms: int = 2000, most: int = 12) -> DataFrame:
    """Of each window the first lines (r_seq, r_start, r_end) that reach into it or its lead-in; their start is moved into the window. One sweep, in which bucket_ms plays no part."""
    hits = first_open(windows.withColumns({"end_ms": F.coalesce("end_ms", "start_ms"), "start_ms": C("start_ms") - lead_ms}), lines, most)
    return hits.withColumn("start_ms", C("start_ms") + lead_ms).withColumn("at_ms", F.greatest("r_start", "start_ms"))


def sounds_in_window(windows: DataFrame, sounds: DataFrame, bucket_ms: int, most: int = 12) -> DataFrame:
    """Of each window (seq) the first sounds (r_seq, r_start, r_end) that begin before its end and last to its start or longer; their start is moved into the window. One sweep, in which bucket_ms plays no part."""
    return first_open(windows, sounds, most).select("seq", "r_seq", F.least("end_ms", F.greatest("r_start", "start_ms")).alias("at_ms"))


def extract_json(text: Column) -> Column:
    """The first JSON object in fenced or plain prose, null if there is none that parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.when(fenced != "", fenced).otherwise(bare)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def validate_analysis(body: Column) -> Column:
    """The analysis with sound elements only, each list bounded; null when the body has another shape."""
    a = F.from_json(body, ANALYSIS)
    some = lambda x: F.coalesce(x, F.array())
    sure = lambda c: F.when(c.isin("high", "medium", "low"), c).otherwise("unknown")
    actions = F.transform(F.slice(F.filter(some(a["actions"]), lambda x: F.trim(F.coalesce(x["description"], F.lit(""))) != ""), 1, 12), lambda x: F.struct(F.coalesce(x["offset_ms"], F.lit(0)).alias("offset_ms"), F.trim(x["description"]).alias("description"), F.slice(F.filter(some(x["participants"]), lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""), 1, 8).alias("participants"), sure(x["confidence"]).alias("confidence")))
    settings = F.transform(F.slice(F.filter(some(a["setting_changes"]), lambda x: F.trim(F.coalesce(x["description"], F.lit(""))) != ""), 1, 4), lambda x: F.struct(F.trim(x["description"]).alias("description"), F.coalesce(F.when(x["int_ext"].isin("INT", "EXT"), x["int_ext"]), F.lit("UNKNOWN")).alias("int_ext"), sure(x["confidence"]).alias("confidence")))
    text = F.slice(F.filter(some(a["text"]), lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != ""), 1, 8)
    people = F.slice(F.filter(some(a["characters"]), lambda x: F.trim(F.coalesce(x["label"], F.lit(""))) != ""), 1, 10)
    doubts = F.slice(F.filter(some(a["uncertainties"]), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), 1, 8)
    return F.when(a.isNotNull() & a["actions"].isNotNull(), F.struct(actions.alias("actions"), people.alias("characters"), settings.alias("setting_changes"), text.alias("text"), doubts.alias("uncertainties")))


def transcript_to_evidence(windows: DataFrame, speakers: DataFrame, bucket_ms: int) -> DataFrame:
    """Speech rows of transcribed windows: segments clamped into their window, or the whole window where there are none; the speaker with the longest overlap.

    windows: title_id, seq, start_ms, end_ms, text, segments (array of start_ms, end_ms, text from the window's start).
    """
    w = windows.select("title_id", C("seq").alias("window_seq"), C("start_ms").alias("a"), C("end_ms").alias("b"), "text", F.posexplode_outer("segments").alias("i", "s"))
    inside = lambda x: F.when(x.isNotNull(), F.least("b", F.greatest("a", C("a") + x)))
    rows = w.select("title_id", "window_seq", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce(inside(C("s.start_ms")), "a").alias("start_ms"), F.coalesce(inside(C("s.end_ms")), "b").alias("end_ms"), F.trim(F.coalesce("s.text", "text")).alias("text")).where("text <> ''")
    rows = rows.withColumn("seq", F.xxhash64("window_seq", "i"))
    who = best_overlap(rows, speakers, bucket_ms).select("seq", C("r_seq").alias("speaker_seq"))
    return rows.join(who.hint("merge"), "seq", "left").select("title_id", "window_seq", "i", "start_ms", "end_ms", "text", "speaker_seq")


def vision_to_evidence(windows: DataFrame) -> DataFrame:
    """title_id, window_seq, source, kind, at_ms, text, confidence, inferred of validated analyses (column v) of windows; offsets are clamped."""
    span = F.greatest(F.lit(0), C("end_ms") - C("start_ms"))
    at = lambda x: C("start_ms") + F.least(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)), span)
    row = lambda source, kind, when, text, sure: F.struct(F.lit(source).alias("source"), F.lit(kind).alias("kind"), when.alias("at_ms"), text.alias("text"), sure.alias("confidence"))
    rows = F.concat(
        F.transform("v.actions", lambda x: row("video", "action", at(x["offset_ms"]), x["description"], x["confidence"])),
        F.transform("v.setting_changes", lambda x: row("video", "setting", at(F.lit(0).cast("long")), x["description"], x["confidence"])),
        F.transform("v.text", lambda x: row("ocr", "text", at(x["offset_ms"]), x["text"], F.lit("low"))),
    )
    return windows.where("v is not null").select("title_id", C("seq").alias("window_seq"), F.explode(rows).alias("r")).select("title_id", "window_seq", "r.*", F.lit(True).alias("inferred"))


def request_table(windows: DataFrame, lines: DataFrame, settings: DataFrame, actions: DataFrame, bucket_ms: int, setting_ms: int = 180_000, action_ms: int = 12_000) -> DataFrame:
    """One row for each window with its dialogue, the setting before it and the newest actions: the input of a user's provider function."""
    said = dialogue_in_window(windows, lines, bucket_ms).groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("at_ms", "r_seq"))), lambda x: x["r_seq"]).alias("dialogue"))
    asked = windows.select("title_id", "seq", C("start_ms").alias("at_ms"))
    setting = top_before(asked, settings, setting_ms, 1, strict=False).select("seq", F.get("values", 0).alias("setting"))
    recent = top_before(asked, actions, action_ms, 3, strict=True).withColumnRenamed("values", "actions")
    none = F.array().cast("array<long>")
    out = windows.join(said.hint("merge"), "seq", "left").join(setting.hint("merge"), "seq", "left").join(recent.hint("merge"), "seq", "left")
    return out.select("title_id", "seq", "start_ms", "end_ms", F.coalesce("dialogue", none).alias("dialogue"), "setting", F.coalesce("actions", none).alias("actions"))
