"""Stored documents: projects as JSON, versions, upserts, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
VERSION = 2
# Limits of a project.
MAX_SCENES, MAX_BEATS, MAX_CHARACTERS, MAX_TEXT = 10_000, 250_000, 25_000, 250_000
PROJECT = """struct<version: int, title: string, characters: array<struct<id: string, name: string>>,
 scenes: array<struct<id: string, start: double, `end`: double, beats: array<struct<id: string, type: string, start: double, text: string>>>>>"""


def check_projects(rows: DataFrame) -> DataFrame:
    """rows (id, body) with p (the parsed project) and reason (null: sound). Scenes are checked by structure and limits."""
    p = rows.withColumn("p", F.from_json("body", PROJECT.replace("\n", "")))
    beats = F.aggregate(F.transform("p.scenes", lambda s: F.coalesce(F.size(s["beats"]), F.lit(0))), F.lit(0), lambda a, b: a + b)
    reason = (
        F.when(C("p").isNull() | C("p.scenes").isNull(), "not a project").when(F.coalesce(C("p.version"), F.lit(1)) > VERSION, "newer version")
        .when(F.size("p.scenes") > MAX_SCENES, "too many scenes").when(beats > MAX_BEATS, "too many beats").when(F.coalesce(F.size("p.characters"), F.lit(0)) > MAX_CHARACTERS, "too many characters")
        .when(F.exists("p.scenes", lambda s: s["id"].isNull() | s["start"].isNull() | (s["start"] < 0) | F.coalesce(s["end"] < s["start"], F.lit(False))), "bad scene")
        .when(F.exists("p.scenes", lambda s: F.exists(F.coalesce(s["beats"], F.array()), lambda b: b["id"].isNull() | b["start"].isNull() | (F.length(F.coalesce(b["text"], F.lit(""))) > MAX_TEXT))), "bad beat")
    )
    return p.withColumn("reason", reason)


def project_tables(checked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """scene, beat, character and quarantine tables of checked projects."""
    good = checked.where("reason is null")
    s = good.select("id", F.explode("p.scenes").alias("s"))
    scene = s.select("id", C("s.id").alias("scene_id"), C("s.start").cast("long").alias("start_ms"), C("s.end").cast("long").alias("end_ms"))
    beat = s.select("id", C("s.id").alias("scene_id"), F.explode("s.beats").alias("b")).select("id", "scene_id", C("b.id").alias("beat_id"), C("b.type").alias("type"), C("b.start").cast("long").alias("start_ms"), C("b.text").alias("text"))
    character = good.select("id", F.explode("p.characters").alias("c")).select("id", C("c.id").alias("character_id"), C("c.name").alias("name"))
    return scene, beat, character, checked.where("reason is not null").select("id", "reason")


def migrate(rows: DataFrame) -> DataFrame:
    """rows (id, version, languages, platform_subtitles) at the present version; a missing one is 1, in which languages stood alone; newer ones are rejected."""
    version = F.coalesce("version", F.lit(1))
    up = rows.withColumn("platform_subtitles", F.when(version < 2, C("languages")).otherwise(C("platform_subtitles")))
    return up.withColumns({"rejected": version > VERSION, "version": F.when(version > VERSION, version).otherwise(VERSION)})


def document_id(platform: str, content: str) -> Column:
    return F.concat_ws(":", platform, content)


def upsert(existing: DataFrame, updates: DataFrame, id_: str, *order: str) -> DataFrame:
    """The newest row of each id, from one aggregation over both."""
    both = existing.unionByName(updates)
    fields = [c for c in both.columns if c != id_]
    return both.groupBy(id_).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_r")).select(id_, "_r.*")


def newest(rows: DataFrame, at: str, id_: str, limit: int = 100) -> DataFrame:
    """The newest documents; a limit is what this list is."""
    return rows.orderBy(F.desc(at), id_).limit(limit)


def delete(rows: DataFrame, ids: DataFrame, id_: str) -> DataFrame:
    return rows.join(ids.select(id_).distinct(), id_, "left_anti")
