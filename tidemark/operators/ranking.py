"""Ranking of variants with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def rank_variants(options: DataFrame) -> DataFrame:
    """Selectable fixed tiers with their rank in the title: resolution, enhanced bitrate, hdr, frame rate, label."""
    order = [F.coalesce("resolution", F.lit(-1)).desc(), C("enhanced").desc(), F.coalesce("hdr", F.lit(False)).desc(), F.coalesce("frame_rate", F.lit(0)).desc(), C("label"), C("option_id")]
    return options.where("selectable and not coalesce(auto, false)").withColumn("rank", F.row_number().over(Window.partitionBy("title_id").orderBy(*order)))


def select_variant(options: DataFrame, wishes: DataFrame) -> DataFrame:
    """title_id, option_id, limited_by: the best tier under the wish's ceiling (null: none) and why it is not better.

    Without a tier under the ceiling the lowest is taken. Who does not prefer enhanced bitrate gets the standard one of the same resolution.
    """
    ranked = rank_variants(options).join(wishes, "title_id").withColumn("fits", C("ceiling").isNull() | (C("resolution") <= C("ceiling")))
    first = lambda v, when=None: F.min_by(v, F.when(when, C("rank")) if when is not None else C("rank"))
    tops = ranked.groupBy("title_id", "ceiling", "prefer_enhanced").agg(
        F.max(F.coalesce("fits", F.lit(False))).alias("any"), first("option_id", C("fits")).alias("top"), first("resolution", C("fits")).alias("top_resolution"), F.max_by("option_id", "rank").alias("lowest"),
        first("resolution").alias("first_resolution"), F.max("resolution").alias("most"),
    )
    same = ranked.select("title_id", "option_id", "rank", "resolution", "enhanced", "fits").join(tops.select("title_id", "top_resolution"), "title_id").where(C("fits") & ~C("enhanced") & C("resolution").eqNullSafe(C("top_resolution")))
    standard = same.groupBy("title_id").agg(F.min_by("option_id", "rank").alias("standard"))
    blocked = options.where("not selectable and not coalesce(auto, false)").join(tops.select("title_id", "top_resolution", "ceiling"), "title_id").where(((C("resolution") > C("top_resolution")) | (C("top_resolution").isNull() & C("resolution").isNotNull())) & (C("ceiling").isNull() | (C("resolution") <= C("ceiling"))))
    out = tops.join(standard, "title_id", "left").join(blocked.select("title_id").distinct().withColumn("blocked", F.lit(True)), "title_id", "left")
    chosen = F.when(~C("any"), C("lowest")).when(C("prefer_enhanced"), C("top")).otherwise(F.coalesce("standard", "top"))
    reason = F.when(~C("any"), "availability").when(C("blocked"), "entitlement").when(C("most") > C("ceiling"), "preference").when(C("first_resolution") < C("ceiling"), "availability")
    return out.select("title_id", chosen.alias("option_id"), reason.alias("limited_by"))


def verify_applied(options: DataFrame, wanted: DataFrame) -> DataFrame:
    """options with applied: the id wanted, or its resolution and bitrate."""
    same = (C("option_id") == C("want_id")) | ((C("resolution") == C("want_resolution")) & (C("enhanced") == C("want_enhanced")))
    return options.join(wanted, "title_id").withColumn("applied", F.coalesce(same, F.lit(False)))


def playback_state(supported: Column, actual: Column, reached: Column) -> Column:
    return F.when(~supported, "unsupported").when(actual.isNull(), "actual-resolution-unknown").when(reached, "best-effort-active").otherwise("optimizing")
