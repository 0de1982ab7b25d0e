"""Feature vectors, budgets and provider results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - cosine of two arrays; 1 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 1.0).otherwise(1 - dot(a, b) / n)


def looks_overlapped(frames: DataFrame, threshold: float = 0.55, least: int = 4) -> DataFrame:
    """title_id, mean_distance, overlapped: whether neighbouring feature vectors differ as much as in mixed speech."""
    prev = F.lag("embedding").over(Window.partitionBy("title_id").orderBy("seq"))
    d = frames.withColumn("prev", prev).where("prev is not null").withColumn("d", cosine_distance("embedding", "prev"))
    return d.groupBy("title_id").agg(F.avg("d").alias("mean_distance"), ((F.count("*") >= least - 1) & (F.avg("d") > threshold)).alias("overlapped"))


def request_budget(base: Column, duration_ms: Column, span_ms: int, coverage: float, short_ms: int, most: int) -> Column:
    """A short title gets as many requests as cover a share of it, up to ``most``; others the base."""
    covering = F.ceil(duration_ms * min(coverage, 1.0) / span_ms)
    more = F.greatest(base, F.least(F.lit(most), covering))
    return F.when(base <= 0, 0).when((duration_ms > 0) & (duration_ms <= short_ms) & F.lit(span_ms > 0 and coverage > 0), more).otherwise(base).cast("int")


def capture_budget(requests: Column, duration_ms: Column, short_ms: int, most: int) -> Column:
    """More candidates than requests: one each 3 s of a short title, each 15 s of a long one, three for each request at least."""
    want = F.when(duration_ms > 0, F.ceil(duration_ms / F.when(duration_ms <= short_ms, 3000).otherwise(15000))).otherwise(requests * 3)
    return F.when(requests <= 0, 0).otherwise(F.least(F.lit(most), F.greatest(requests * 3, want))).cast("int")


def salient_moments(results: DataFrame) -> DataFrame:
    """title_id, seq, at_ms, weight of every described action; offsets are clamped into the window."""
    a = results.select("title_id", "seq", "start_ms", "end_ms", F.explode("actions").alias("a")).where(F.trim("a.description") != "")
    at = C("start_ms") + F.least(F.greatest(C("a.offset_ms"), F.lit(0)), F.greatest(C("end_ms") - C("start_ms"), F.lit(0)))
    weight = F.when(C("a.confidence") == "high", 1.0).when(C("a.confidence") == "medium", 0.8).when(C("a.confidence") == "low", 0.55).otherwise(0.5)
    return a.select("title_id", "seq", at.alias("at_ms"), weight.alias("weight"))
