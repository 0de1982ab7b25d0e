"""Adaptive windows of a title."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import Subdivide, ordered_fold
from ..operators.intervals import overlap_join

C = F.col


def stretches(events: DataFrame) -> DataFrame:
    """title_id, low, high between hard cuts: ends of the span, scene changes, seeks."""
    hard = F.coalesce((C("source") == "video") & (C("kind") == "scene-change") | (C("source") == "playback") & (C("kind") == "seek"), F.lit(False))
    ends = events.groupBy("title_id").agg(F.min("start_ms").alias("a"), (F.max(F.coalesce("end_ms", "start_ms")) + 1).alias("b")).select("title_id", F.explode(F.array("a", "b")).alias("low"))
    cuts = events.where(hard).select("title_id", C("start_ms").alias("low")).unionByName(ends).distinct()
    return cuts.withColumn("high", F.lead("low").over(Window.partitionBy("title_id").orderBy("low"))).where("high is not null")


def adaptive_windows(events: DataFrame, longest: int = 12_000, target: int = 4000, shortest: int = 800, gap: int = 700) -> DataFrame:
    """title_id, start_ms, end_ms. Only stretches over ``longest`` go through the fold, keyed by stretch."""
    s = stretches(events)
    fine = s.where(C("high") - C("low") <= longest).select("title_id", C("low").alias("start_ms"), C("high").alias("end_ms"))
    long_ = s.where(C("high") - C("low") > longest)
    spoken = events.where(C("source").isin("subtitle", "audio-asr")).select("title_id", C("start_ms").alias("r_start"), F.coalesce("end_ms", C("start_ms") + 500).alias("r_end"))
    inside = overlap_join(long_.select("title_id", "low", "high", C("low").alias("start_ms"), C("high").alias("end_ms")), spoken, longest * 4).select("title_id", "low", "high", C("r_start").alias("spoken_start"), C("r_end").alias("spoken_end"))
    none = long_.select("title_id", "low", "high", F.lit(None).cast("long").alias("spoken_start"), F.lit(None).cast("long").alias("spoken_end"))
    cuts = ordered_fold(inside.unionByName(none), ["title_id", "low"], ["spoken_start"], lambda: Subdivide(longest, target, shortest, gap), "title_id long, low long, start_ms long")
    ends = cuts.join(long_.hint("merge"), ["title_id", "low"]).withColumn("end_ms", F.coalesce(F.lead("start_ms").over(Window.partitionBy("title_id", "low").orderBy("start_ms")), "high"))
    return fine.unionByName(ends.select("title_id", "start_ms", "end_ms"))
