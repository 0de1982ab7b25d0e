"""Aggregations over evidence, scenes and observations. All of them combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import confidence_rank, corroborate, from_rank

C = F.col


def first_seen(value: str, order: str | Column) -> Column:
    """Aggregate: the distinct values by their first appearance. The number of values of a group should be small."""
    pairs = F.array_sort(F.collect_set(F.when(C(value).isNotNull(), F.struct(order if isinstance(order, Column) else C(order), C(value).alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda x: x["v"]))


def provenance_from(events: DataFrame, *by: str) -> DataFrame:
    """by, evidence_ids and sources in order of appearance, corroborated confidence, inferred if any is."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "seq"))), lambda x: x["seq"])
    return events.groupBy(*by).agg(ids.alias("evidence_ids"), first_seen("source", F.struct("start_ms", "seq")).alias("sources"), corroborate(C("confidence"), C("source")).alias("confidence"), F.bool_or("inferred").alias("inferred"))


def merge_provenance(rows: DataFrame, *by: str) -> DataFrame:
    """Distinct ids and sources of several provenances, the least confidence, inferred if any is."""
    return rows.groupBy(*by).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        from_rank(F.coalesce(F.min(confidence_rank(C("confidence"))), F.lit(0))).alias("confidence"),
        F.coalesce(F.bool_or("inferred"), F.lit(False)).alias("inferred"),
    )


def source_status(events: DataFrame) -> DataFrame:
    """Per title and source: active, number of events, start of the last that came."""
    return events.groupBy("title_id", "source").agg(F.lit("active").alias("state"), F.count("*").alias("event_count"), F.max_by("start_ms", "seq").alias("last_event_at"))


def count_kinds(rows: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """A column for each kind, 0 where there is none."""
    return rows.groupBy(by).agg(*[F.count_if(C(kind) == k).alias(k) for k in kinds])


def derive_setting(events: DataFrame) -> DataFrame:
    """Per title the setting event of the best confidence, the first on ties; confidence is medium at most."""
    best = events.groupBy("title_id").agg(F.max_by(F.struct("value", "confidence", "seq"), F.struct(confidence_rank(C("confidence")), -C("start_ms"), -C("seq"))).alias("b"))
    return best.select("title_id", C("b.value").alias("description"), from_rank(F.least(confidence_rank(C("b.confidence")), F.lit(2))).alias("confidence"), C("b.seq").alias("seq"))


def speech_gaps(merged: DataFrame, by: str = "title_id") -> DataFrame:
    """Gaps between merged ranges: by, start_ms, end_ms, gap_ms."""
    prev = F.lag("end_ms").over(Window.partitionBy(by).orderBy("start_ms"))
    return merged.select(by, prev.alias("s"), C("start_ms").alias("e")).where("s is not null").select(by, C("s").alias("start_ms"), C("e").alias("end_ms"), (C("e") - C("s")).alias("gap_ms"))


def median_gap(gaps: DataFrame, by: str = "title_id") -> DataFrame:
    """The exact median, from counts of each length, so that a long title needs no single buffer of rows."""
    return gaps.groupBy(by).agg(F.percentile("gap_ms", 0.5).alias("median_ms"))


def frame_rate(frames: DataFrame, most: int = 60) -> DataFrame:
    """Frames per second from the upper median of the last ``most`` steps between 0 and 500 ms; null with fewer than five."""
    order = Window.partitionBy("title_id").orderBy("at_ms", "seq")
    steps = frames.withColumn("step", C("at_ms") - F.lag("at_ms").over(order)).where("step > 0 and step < 500")
    last = steps.withColumn("n", F.row_number().over(Window.partitionBy("title_id").orderBy(F.desc("at_ms"), F.desc("seq")))).where(C("n") <= most)
    sorted_ = last.groupBy("title_id").agg(F.array_sort(F.collect_list("step")).alias("s"))
    middle = F.get("s", F.floor(F.size("s") / 2).cast("int"))
    return sorted_.select("title_id", F.when(F.size("s") >= 5, F.floor(100000.0 / middle + 0.5) / 100).alias("fps"))


def rate_between(samples: DataFrame) -> DataFrame:
    """Change of ``total`` per minute since the sample before, rounded half up."""
    order = Window.partitionBy("title_id").orderBy("at_ms", "seq")
    minutes = (C("at_ms") - F.lag("at_ms").over(order)) / 60000
    change = C("total") - F.lag("total").over(order)
    return samples.withColumn("per_minute", F.when(minutes > 0, F.floor(change / minutes + 0.5).cast("long")))


def histogram(rows: DataFrame, id_: str, values: str, bins: int = 32, low: float = 0.0, high: float = 256.0) -> DataFrame:
    """id, histogram (shares of ``bins`` equal bins), mean, std of an array column; within the row, without a shuffle."""
    at = F.transform(values, lambda v: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((v.cast("double") - low) * (bins / (high - low))).cast("int"))))
    a = rows.select(id_, F.transform(values, lambda v: v.cast("double")).alias("v"), at.alias("at"))
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter("at", lambda x: x == b)) / F.size("at"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    b = a.select(id_, "v", share.alias("histogram"), mean.alias("mean"))
    return b.select(id_, "histogram", "mean", F.sqrt(F.aggregate(F.transform("v", lambda x: (x - C("mean")) * (x - C("mean"))), F.lit(0.0), lambda s, x: s + x) / F.size("v")).alias("std"))


def first_by(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The first row of each key, whole."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def newest_by(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The last row of each key, whole: the deterministic upsert."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(*order)).alias("_r")).select(*by, "_r.*")
