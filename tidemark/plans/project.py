"""The whole project of every title from its evidence: scenes, beats, characters, coverage and the rendered lines.

Clean evidence, boundaries, fused dialogue and placed beats are written once
each; what follows are joins and aggregations by title and scene.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import confidence_rank, corroborate, from_rank
from ..functions.labels import parse_setting, scene_heading
from ..functions.text import is_non_speech
from ..operators.aggregates import first_seen
from ..operators.boundaries import scene_table, split_scenes
from ..operators.settle import settle
from .build import covered, cut
from .characters import cue_name, ensure_characters
from .fusion import attribute, fuse_dialogue, fuse_other, order_beats
from .render import render

C = F.col


@dataclass(frozen=True)
class Project:
    """scenes: title_id, scene, scene_id, start_ms, end_ms, events, setting, heading, evidence_sources, confidence, beats, characters.

    beats: title_id, scene, place, seq, beat_id, type, start_ms, end_ms, character_id, name, attribution, text, variants, sources, confidence.
    presence: title_id, scene, character_id, lines, first_ms, last_ms. characters: as of ensure_characters, with cue.
    """

    scenes: DataFrame
    beats: DataFrame
    presence: DataFrame
    characters: DataFrame
    conflicts: DataFrame
    coverage: DataFrame
    lines: DataFrame


def build_project(events: DataFrame, bucket_ms: int = 10_000, onset_ms: int = 1500, near_ms: int = 1200, language: str = "en", dedupe_ms: int = 1500, window_ms: int = 1200, least_scene_ms: int = 6000, least_gap_ms: int = 6000) -> Project:
    """events: title_id, seq, source, kind, key, text, language, start_ms, end_ms, cut, significant, duration_ms, confidence."""
    clean, found = cut(events, dedupe_ms, window_ms, least_scene_ms, least_gap_ms)
    placed = settle(split_scenes(clean, found), "project-placed")
    scenes = scene_table(placed)
    columns = ["title_id", "seq", "start_ms", "end_ms", "text", "language", "confidence"]
    cues = placed.where((C("source") == "subtitle") & C("text").isNotNull() & ~F.coalesce(is_non_speech(C("text")), F.lit(False))).select(*columns)
    dialogue, clash = fuse_dialogue(cues, placed.where("source = 'audio-asr'").select(*columns), bucket_ms, onset_ms)
    none = lambda kind: F.lit(None).cast(kind)
    spoken = dialogue.select("title_id", F.get("evidence_ids", 0).alias("seq"), "beat_id", F.lit("dialogue").alias("type"), "start_ms", "end_ms", "speaker", "text", "variants", F.array_join("sources", ",").alias("sources"), "confidence")
    kept = fuse_other(placed, near_ms).join(placed.select("seq", "end_ms", "source", C("confidence").alias("sure")).hint("merge"), "seq")
    other = kept.select("title_id", "seq", F.md5(F.concat_ws(":", "type", "title_id", "start_ms", "seq")).alias("beat_id"), "type", "start_ms", "end_ms", none("string").alias("speaker"), "text", none("map<string,string>").alias("variants"), C("source").alias("sources"), C("sure").alias("confidence"))
    # beats of one id are one beat: the first
    one = Window.partitionBy("title_id", "beat_id").orderBy("seq")
    beats = settle(spoken.unionByName(other).withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n"), "project-spoken")
    beats = settle(split_scenes(beats, found), "project-beats")
    talk = beats.where("type = 'dialogue'")
    characters = settle(cue_name(ensure_characters(talk.select("title_id", C("start_ms").alias("at_ms"), "seq", C("speaker").alias("name"), none("string").alias("speaker")))), "project-characters")
    key = F.concat(F.lit("name:"), F.lower(F.trim(F.regexp_replace("speaker", r"\s+", " "))))
    named = talk.withColumn("key", key).join(characters.select("title_id", "key", "character_id").hint("merge"), ["title_id", "key"], "left")
    heard = named.where("character_id is not null").groupBy("title_id", "scene").agg(F.sort_array(F.collect_set("character_id")).alias("present"))
    asked = named.join(heard.hint("merge"), ["title_id", "scene"], "left").select("title_id", "seq", C("start_ms").alias("at_ms"), C("character_id").alias("label"), none("string").alias("assigned"), none("string").alias("diarized"), F.lit(False).alias("visual"), F.lit(False).alias("sure"), "present")
    who = attribute(asked).select("title_id", "seq", "character_id", "attribution").join(characters.select("title_id", "character_id", C("cue").alias("name")).hint("merge"), ["title_id", "character_id"], "left")
    beats = settle(order_beats(beats.join(who.hint("merge"), ["title_id", "seq"], "left").withColumn("character_id", F.when(C("type") == "dialogue", C("character_id")))), "project-ordered")
    presence = beats.where("character_id is not null").groupBy("title_id", "scene", "character_id").agg(F.count("*").alias("lines"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))
    said = beats.groupBy("title_id", "scene").agg(F.count("*").alias("beats"), F.count_distinct("character_id").alias("characters"))
    places = placed.where("source = 'video' and kind = 'setting' and text is not null").groupBy("title_id", "scene").agg(F.max_by("text", F.struct(confidence_rank(C("confidence")), -C("start_ms"), -C("seq"))).alias("setting"))
    proof = placed.groupBy("title_id", "scene").agg(F.array_join(first_seen("source", F.struct("start_ms", "source")), ",").alias("evidence_sources"), corroborate(C("confidence"), C("source")).alias("confidence"))
    by = ["title_id", "scene"]
    full = scenes.join(places.hint("merge"), by, "left").join(proof.hint("merge"), by, "left").join(said.hint("merge"), by, "left")
    parsed = full.withColumn("_s", parse_setting(C("setting")))
    full = parsed.withColumns({"heading": scene_heading(C("_s.place"), C("_s.int_ext"), C("_s.time_of_day"), F.lit(language)), "beats": F.coalesce("beats", F.lit(0)), "characters": F.coalesce("characters", F.lit(0))}).drop("_s")
    headings = full.select("title_id", "start_ms", F.coalesce("heading", F.concat(F.lit("SCENE "), (C("scene") + 1).cast("string"))).alias("text"))
    return Project(full, beats, presence, characters, clash, covered(clean), render(beats, headings))


def mark_complete(coverage: DataFrame, complete: DataFrame) -> DataFrame:
    """coverage with complete: whether some source of a title (title_id, source) was read whole, such as a caption file; such a title has ratio 1."""
    whole = complete.groupBy("title_id").agg(F.lit(True).alias("complete"))
    out = coverage.join(whole.hint("merge"), "title_id", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    return out.withColumn("ratio", F.when(C("complete"), 1.0).otherwise(C("ratio")))


def least_confident(beats: DataFrame) -> DataFrame:
    """title_id, confidence: the least of a title's beats."""
    return beats.groupBy("title_id").agg(from_rank(F.min(confidence_rank(C("confidence")))).alias("confidence"))
