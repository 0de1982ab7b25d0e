"""Scene boundaries: scored signals, anchored clusters, selection; scenes between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import from_score
from .aggregates import median_gap, speech_gaps
from .folds import Cluster, Select, ordered_fold
from .intervals import merge_ranges
from .settle import settle

C = F.col
# Weights of the kinds of signals.
WEIGHTS = {
    "chapter-change": 0.9, "location-change": 0.6, "user-seek": 0.55, "long-silence": 0.35, "ambience-change": 0.35,
    "on-screen-text": 0.3, "music-transition": 0.25, "dialogue-gap": 0.6, "visual-cut": 0.2,
}


def gap_strength(gap: Column, median: Column) -> Column:
    """How far a pause exceeds the usual one; without a usual one, its share of 30 s."""
    relative = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (gap / median - 2) / 6))
    return F.when(F.coalesce(median, F.lit(0)) <= 0, F.least(F.lit(1.0), gap / 30000)).otherwise(relative)


def gap_signals(events: DataFrame, least_gap: int = 6000) -> DataFrame:
    """Pauses of speech as signals in their middle."""
    spoken = events.where(C("source").isin("subtitle", "audio-asr")).select("title_id", "start_ms", F.coalesce("end_ms", C("start_ms") + 1000).alias("end_ms"))
    gaps = speech_gaps(merge_ranges(spoken))
    scored = gaps.join(median_gap(gaps), "title_id").where(C("gap_ms") >= least_gap)
    return scored.select("title_id", F.lit("dialogue-gap").alias("kind"), (C("start_ms") + F.floor(C("gap_ms") / 2)).alias("at_ms"), gap_strength(C("gap_ms"), C("median_ms")).alias("strength"))


def signals(events: DataFrame, least_gap: int = 6000) -> DataFrame:
    """title_id, kind, at_ms, strength; events: title_id, source, kind, start_ms, end_ms, cut, significant, duration_ms."""
    s, k = C("source"), C("kind")
    kind = (
        F.when((s == "video") & (k == "scene-change") & (C("cut") > 0), "visual-cut").when((s == "video") & (k == "setting"), "location-change")
        .when((s == "audio-event") & (k == "ambience-change"), "ambience-change").when((s == "audio-event") & k.isin("music-start", "music-end"), "music-transition")
        .when((s == "audio-silence") & C("significant"), "long-silence").when((s == "playback") & (k == "seek"), "user-seek")
        .when((s == "metadata") & (k == "chapter"), "chapter-change").when(s == "ocr", "on-screen-text")
    )
    what = C("signal")
    strength = (
        F.when(what == "visual-cut", F.least(F.lit(1.0), C("cut"))).when(what == "location-change", 0.8).when(what == "ambience-change", 0.7).when(what == "music-transition", 0.5)
        .when(what == "long-silence", F.least(F.lit(1.0), C("duration_ms") / 8000)).when(what == "on-screen-text", 0.6).otherwise(1.0)
    )
    at = F.when(what == "long-silence", F.coalesce("end_ms", "start_ms")).otherwise(C("start_ms"))
    own = events.withColumn("signal", kind).where("signal is not null").select("title_id", what.alias("kind"), at.alias("at_ms"), strength.alias("strength"))
    return own.unionByName(gap_signals(events, least_gap))


def anchored_clusters(rows: DataFrame, window_ms: int) -> DataFrame:
    """title_id, seq, at_ms, cluster: a number that is unique in the title. Pauses longer than the window part rows into runs; only runs of several rows need the fold."""
    order = Window.partitionBy("title_id").orderBy("at_ms", "seq")
    new = F.when(C("at_ms") - F.lag("at_ms").over(order) <= window_ms, 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(order)).withColumn("_alone", (C("_new") == 1) & (F.coalesce(F.lead("_new").over(order), F.lit(1)) == 1))
    alone = runs.where("_alone").select("title_id", "run", "seq", "at_ms", F.lit(0).cast("long").alias("cluster"))
    folded = ordered_fold(runs.where("not _alone").select("title_id", "run", "at_ms", "seq"), ["title_id", "run"], ["at_ms", "seq"], lambda: Cluster(window_ms), "title_id long, run long, seq long, at_ms long, cluster long")
    return alone.unionByName(folded).select("title_id", "seq", "at_ms", F.concat_ws("-", "run", "cluster").alias("cluster"))


def score_candidates(sig: DataFrame, window_ms: int = 1200) -> DataFrame:
    """title_id, at_ms, score, confidence of each cluster of signals: the best of each kind, discounted by 0.6 in turn."""
    weight = F.lit(None).cast("double")
    for k, w in WEIGHTS.items():
        weight = F.when(C("kind") == k, w).otherwise(weight)
    # written once: the clusters read the rows beside the join with them
    rows = settle(sig.withColumn("value", weight * C("strength")).withColumn("seq", F.row_number().over(Window.partitionBy("title_id").orderBy("at_ms", "kind", "strength")).cast("long")), "signals")
    placed = rows.join(anchored_clusters(rows.select("title_id", "at_ms", "seq"), window_ms).drop("at_ms").hint("merge"), ["title_id", "seq"])
    best = placed.groupBy("title_id", "cluster", "kind").agg(F.max("value").alias("value"), F.min("at_ms").alias("first"))
    when = lambda k: F.min(F.when(C("kind") == k, C("first")))
    one = best.groupBy("title_id", "cluster").agg(
        F.coalesce(when("visual-cut"), when("chapter-change"), when("user-seek"), F.min("first")).alias("at_ms"), F.count("*").alias("kinds"), F.sort_array(F.collect_list("value"), asc=False).alias("v")
    )
    total = F.aggregate(F.transform("v", lambda x, i: x * F.pow(F.lit(0.6), i)), F.lit(0.0), lambda s, x: s + x)
    scored = one.withColumn("score", F.least(F.lit(1.0), total))
    return scored.select("title_id", "at_ms", "score", from_score(C("score"), C("kinds") >= 2).alias("confidence"))


def select_boundaries(candidates: DataFrame, threshold: float = 0.55, least_ms: int = 6000) -> DataFrame:
    return ordered_fold(candidates, ["title_id"], ["at_ms"], lambda: Select(threshold, least_ms), "title_id long, at_ms long, score double, confidence string")


def detect_boundaries(events: DataFrame, window_ms: int = 1200, threshold: float = 0.55, least_ms: int = 6000, least_gap: int = 6000) -> DataFrame:
    return select_boundaries(score_candidates(signals(events, least_gap), window_ms), threshold, least_ms)


def split_scenes(events: DataFrame, boundaries: DataFrame, chunk_ms: int = 86_400_000) -> DataFrame:
    """events with scene (its number in the title): the last boundary at or before the start opens its scene.

    A running count by chunks of time: each chunk begins with the number of boundaries of the chunks before, so only a chunk is sorted in a task.
    """
    marks = boundaries.select("title_id", C("at_ms").alias("start_ms"), F.lit(0).alias("_side"), F.lit(1).alias("_cut"))
    rows = events.withColumns({"_side": F.lit(1), "_cut": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn("_chunk", F.floor(C("start_ms") / chunk_ms))
    before = Window.partitionBy("title_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    cuts = rows.groupBy("title_id", "_chunk").agg(F.sum("_cut").alias("_cut"))
    carried = cuts.select("title_id", "_chunk", F.lit(-1).alias("_side"), F.coalesce(F.sum("_cut").over(before), F.lit(0)).cast("int").alias("_cut"))
    order = Window.partitionBy("title_id", "_chunk").orderBy((C("_side") >= 0).cast("int"), "start_ms", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(carried, allowMissingColumns=True).withColumn("scene", F.sum("_cut").over(order)).where("_side = 1").drop("_side", "_cut", "_chunk")


def scene_table(placed: DataFrame) -> DataFrame:
    """title_id, scene, scene_id, start_ms, end_ms, events: scenes without events do not appear."""
    out = placed.groupBy("title_id", "scene").agg(F.min("start_ms").alias("start_ms"), F.max(F.coalesce("end_ms", "start_ms")).alias("end_ms"), F.count("*").alias("events"))
    nxt = F.lead("start_ms").over(Window.partitionBy("title_id").orderBy("scene"))
    clipped = F.least("end_ms", F.coalesce(nxt, "end_ms"))
    return out.select("title_id", "scene", F.md5(F.concat_ws(":", F.lit("scene"), "title_id", "start_ms")).alias("scene_id"), "start_ms", clipped.alias("end_ms"), "events")
