"""The one-pass build: evidence to scenes, beats and coverage of every title."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.boundaries import detect_boundaries, scene_table, split_scenes
from ..operators.intervals import coverage_report
from ..operators.sequences import dedupe_events
from ..operators.settle import settle

C = F.col


def cut(events: DataFrame, dedupe_ms: int = 1500, window_ms: int = 1200, least_scene_ms: int = 6000, least_gap_ms: int = 6000) -> tuple[DataFrame, DataFrame]:
    """Events without duplicates and the boundaries between scenes, each written once."""
    # events without a key are never duplicates: they pass by the shuffles
    keyed, free = events.where("key is not null"), events.where("key is null").withColumn("end_ms", F.coalesce("end_ms", "start_ms"))
    kept = dedupe_events(keyed, dedupe_ms).select("seq", C("end_ms").alias("_end"))
    clean = settle(keyed.join(kept.hint("merge"), "seq").withColumn("end_ms", C("_end")).drop("_end").unionByName(free), "build-clean")
    return clean, settle(detect_boundaries(clean, window_ms, least_ms=least_scene_ms, least_gap=least_gap_ms), "build-boundaries")


def covered(clean: DataFrame) -> DataFrame:
    """coverage_report of the events; one without an end counts for 100 ms."""
    durations = clean.groupBy("title_id").agg(F.max(F.coalesce("end_ms", "start_ms")).alias("duration_ms"))
    observed = clean.withColumn("end_ms", F.greatest(F.coalesce("end_ms", "start_ms"), C("start_ms") + 100))
    return coverage_report(observed, durations)


def build(events: DataFrame, dedupe_ms: int = 1500, window_ms: int = 1200, least_scene_ms: int = 6000, least_gap_ms: int = 6000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """scenes, placed events and coverage. events: title_id, seq, source, kind, key, start_ms, end_ms, cut, significant, duration_ms."""
    clean, found = cut(events, dedupe_ms, window_ms, least_scene_ms, least_gap_ms)
    placed = split_scenes(clean, found)
    return scene_table(placed), placed, covered(clean)


def inspect(scenes: DataFrame, placed: DataFrame, coverage: DataFrame) -> DataFrame:
    """title_id, scenes, events, sources, ratio."""
    a = scenes.groupBy("title_id").agg(F.count("*").alias("scenes"))
    b = placed.groupBy("title_id").agg(F.count("*").alias("events"), F.count_distinct("source").alias("sources"))
    return a.join(b, "title_id").join(coverage.select("title_id", "ratio"), "title_id")


def finalize(scenes: DataFrame, now: DataFrame, behind_ms: int = 8000) -> DataFrame:
    """scenes with status: finalized where they and all before them ended ``behind_ms`` before the title's playhead (title_id, now_ms)."""
    done = C("end_ms") < C("now_ms") - behind_ms
    s = scenes.join(now, "title_id").withColumn("_open", F.when(done, 0).otherwise(1))
    opened = F.sum("_open").over(Window.partitionBy("title_id").orderBy("start_ms").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("status", F.when(opened == 0, "finalized").otherwise("provisional")).drop("_open", "now_ms")
