"""Interval operators per title: union, complement, coverage, overlap joins.

An interval join deals both sides into the nodes of a time tree, so it is an
equality join for Spark: buckets on the lowest level, twice as wide on each
level above. A range lies on the level where it spans two nodes at most, and
two ranges meet on the higher of their levels, where the other's ancestors are;
a range of any length is a few rows. Unions run twice, within buckets and over
what these leave, and as-of joins carry the last value of each chunk of time
into the next, so that a long title is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def _union(df: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(C("start_ms") <= reach + tolerance, 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
    return marked.groupBy(*by, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_island")


def merge_ranges(df: DataFrame, tolerance: int = 0, by: str = "title_id", chunk_ms: int = 86_400_000) -> DataFrame:
    """by, start_ms, end_ms of the union; ranges join when the next starts at most ``tolerance`` after the reach. Null ends are points; null starts go."""
    r = df.where("start_ms is not null").select(by, "start_ms", F.greatest("start_ms", F.coalesce("end_ms", "start_ms")).alias("end_ms"))
    part = _union(r.withColumn("_chunk", F.floor(C("start_ms") / chunk_ms)), [by, "_chunk"], tolerance).drop("_chunk")
    return _union(part, [by], tolerance)


def covered_duration(df: DataFrame, by: str = "title_id") -> DataFrame:
    return merge_ranges(df, 0, by).groupBy(by).agg(F.sum(C("end_ms") - C("start_ms")).alias("covered_ms"))


def invert_ranges(merged: DataFrame, durations: DataFrame, by: str = "title_id") -> DataFrame:
    """Gaps of merged ranges in [0, duration_ms]; durations: by, duration_ms. A title without ranges is one gap."""
    clipped = merged.join(durations, by).select(by, F.greatest(C("start_ms"), F.lit(0)).alias("s"), F.least("end_ms", "duration_ms").alias("e")).where("e >= s")
    ends = durations.select(by, C("duration_ms").alias("s"), C("duration_ms").alias("e"), F.lit(1).alias("_last"))
    rows = clipped.withColumn("_last", F.lit(0)).unionByName(ends)
    order = Window.partitionBy(by).orderBy("s", "_last", "e")
    gaps = rows.withColumn("start_ms", F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return gaps.where(C("s") > C("start_ms")).select(by, "start_ms", C("s").alias("end_ms"))


def coverage_report(df: DataFrame, durations: DataFrame, tolerance_ms: int = 250, most: int = 20, by: str = "title_id") -> DataFrame:
    """by, duration_ms, observed (number of ranges), covered_ms, ratio (at most 1; null without a duration), gaps, notes (the first gaps and how many more)."""
    from ..functions.time import format_timecode

    merged = merge_ranges(df, tolerance_ms, by)
    sums = merged.groupBy(by).agg(F.count("*").alias("observed"), F.sum(C("end_ms") - C("start_ms")).alias("covered_ms"))
    gaps = invert_ranges(merged, durations, by)
    place = F.row_number().over(Window.partitionBy(by).orderBy("start_ms"))
    said = F.concat(format_timecode(C("start_ms")), F.lit(" to "), format_timecode(C("end_ms")))
    notes = gaps.withColumn("n", place).groupBy(by).agg(F.count("*").alias("gaps"), F.array_sort(F.collect_list(F.when(C("n") <= most, F.struct("n", said.alias("note"))))).alias("first"))
    full = F.concat(F.transform("first", lambda x: x["note"]), F.when(C("gaps") > most, F.array(F.concat(F.lit("and "), (C("gaps") - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>")))
    out = durations.join(sums, by, "left").join(notes, by, "left")
    ratio = F.when(C("duration_ms") > 0, F.least(F.lit(1.0), F.coalesce("covered_ms", F.lit(0)) / C("duration_ms")))
    return out.select(by, "duration_ms", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("covered_ms", F.lit(0)).alias("covered_ms"), ratio.alias("ratio"), F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce(full, F.array().cast("array<string>")).alias("notes"))


def _level(start: Column, end: Column, bucket_ms: int) -> Column:
    """The lowest level of the tree on which a range spans two nodes at most; null for a null start."""
    steps = F.floor(F.greatest(start, F.coalesce(end, start)) / bucket_ms) - F.floor(start / bucket_ms)
    return F.when(steps <= 1, 0).otherwise(F.length(F.bin(steps - 1)))


def _nodes(df: DataFrame, start: str, end: str, bucket_ms: int, levels: Column, other: bool) -> DataFrame:
    """df with its nodes (_level, _node) on its own level and on all used levels above, and _meets, the half of the join they are in.

    One half joins left ranges on their own level with all right ones there, the other half left ancestors with right ranges on
    their own level; ancestors never meet ancestors.
    """
    low, own = F.floor(C(start) / bucket_ms), _level(C(start), C(end), bucket_ms)
    high = F.greatest(low, F.floor(F.coalesce(end, start) / bucket_ms))
    used = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: (F.call_function("getbit", C("_used"), k) == 1) & (k >= C("_own")))
    placed = df.where(C(start).isNotNull()).withColumns({"_own": own, "_low": low, "_high": high, "_used": levels}).withColumn("_level", F.explode(used))
    up = lambda c: F.call_function("shiftright", C(c), C("_level"))
    placed = placed.withColumn("_node", F.explode(F.sequence(up("_low"), up("_high"))))
    at_home = C("_level") == C("_own")
    half = F.explode(F.when(at_home, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))) if other else F.when(at_home, 0).otherwise(1)
    return placed.withColumn("_meets", half).drop("_own", "_low", "_high", "_used")


def overlap_join(left: DataFrame, right: DataFrame, bucket_ms: int, by: str = "title_id", closed: bool = False, how: str = "inner") -> DataFrame:
    """Pairs of left (start_ms, end_ms) and right (r_start, r_end) that overlap, strictly and half-open; closed: a right side that ends where the left starts counts.

    bucket_ms should be about the usual length of a range; longer ones cost two rows for each level in use. how: inner, left_semi
    or left_anti. A null end is the range's start; rows with a null start meet nothing. The levels in use are a subquery over
    both sides, so a side that is dear to compute should be written first.
    """
    from_, to = F.coalesce("end_ms", "start_ms"), F.coalesce("r_end", "r_start")
    level = left.select(_level(C("start_ms"), C("end_ms"), bucket_ms).alias("k")).unionAll(right.select(_level(C("r_start"), C("r_end"), bucket_ms).alias("k")))
    levels = level.agg(F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), C("k"))), F.lit(0).cast("long"))).scalar()
    shared = F.call_function("shiftright", F.floor(F.greatest("start_ms", "r_start") / bucket_ms), C("_level")) == C("_node")
    meets = (C("r_start") < from_) & ((to >= C("start_ms")) if closed else (C("start_ms") < to))
    a, b = _nodes(left, "start_ms", "end_ms", bucket_ms, levels, False), _nodes(right, "r_start", "r_end", bucket_ms, levels, True)
    on = [by, "_level", "_node", "_meets"]
    if how == "inner":
        return a.hint("merge").join(b.hint("merge"), on).where(shared & meets).drop(*on[1:])
    key = [c for c in left.columns]
    hits = a.hint("merge").join(b.hint("merge"), on).where(meets).select(*key).distinct()
    same = [left[c].eqNullSafe(hits[c]) for c in key]
    return left.join(hits.hint("merge"), same, how)


def near_join(left: DataFrame, right: DataFrame, tolerance_ms: int, by: str = "title_id") -> DataFrame:
    """Pairs with |at_ms - r_at| <= tolerance_ms, found in buckets of that width and their neighbours."""
    a = left.withColumn("_bucket", F.explode(F.sequence(F.floor((C("at_ms") - tolerance_ms) / tolerance_ms), F.floor((C("at_ms") + tolerance_ms) / tolerance_ms))))
    b = right.withColumn("_bucket", F.floor(C("r_at") / tolerance_ms))
    return a.hint("merge").join(b.hint("merge"), [by, "_bucket"]).where(F.abs(C("at_ms") - C("r_at")) <= tolerance_ms).drop("_bucket")


def as_of(left: DataFrame, right: DataFrame, columns: list[str], by: str = "title_id", tie: str = "seq", chunk_ms: int = 86_400_000, strict: bool = False) -> DataFrame:
    """left (at_ms) with the columns of the last row of right (at_ms) at or (strict) before it, null if none: a prefix scan over chunks of time.

    The last row of right in each chunk is carried over the later chunks of its title (one small row for each chunk in use) and
    stands there before all others; the rows themselves are sorted within their chunk only. Rows without a time get null.
    """
    payload = right.where("at_ms is not null").select(by, "at_ms", F.lit(0).alias("_side"), C(tie).alias("_tie"), F.struct(*columns).alias("_hit"))
    asked = left.select(by, "at_ms", F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[tie]).alias("_tie"), F.struct(*[c for c in left.columns]).alias("_row"))
    chunk = F.floor(C("at_ms") / chunk_ms).alias("_chunk")
    # times are kept within the chunk, so a carried row needs none of its own
    both = payload.unionByName(asked, allowMissingColumns=True).select("*", chunk)
    last = payload.select(by, chunk, F.struct("at_ms", "_tie").alias("_at"), "_hit").groupBy(by, "_chunk").agg(F.max_by("_hit", "_at").alias("_hit"))
    used = asked.where("at_ms is not null").select(by, chunk, F.lit(None).cast(last.schema["_hit"].dataType).alias("_hit"))
    ends = last.unionByName(used).groupBy(by, "_chunk").agg(F.first("_hit", ignorenulls=True).alias("_hit"))
    before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(by, "_chunk", F.lit(-1).alias("_side"), F.last("_hit", ignorenulls=True).over(before).alias("_hit")).where("_hit is not null")
    order = Window.partitionBy(by, "_chunk").orderBy((C("_side") >= 0).cast("int"), "at_ms", -C("_side") if strict else C("_side"), "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.unionByName(carried, allowMissingColumns=True).withColumn("_hit", F.last("_hit", ignorenulls=True).over(order)).where("_side = 1")
    return out.select("_row.*", *[C(f"_hit.{c}").alias(f"r_{c}") for c in columns])


def overlapping(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a < d) & (c < b)
