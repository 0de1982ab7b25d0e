"""Ordered operators that window functions express: upserts, silences, frame metrics, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def per_title(*order: str) -> Window:
    return Window.partitionBy("title_id").orderBy(*order)


def dedupe_events(events: DataFrame, window_ms: int = 1500) -> DataFrame:
    """title_id, key, seq, start_ms, end_ms, merged: anchored greedy per key; null keys are never duplicates.

    Rows that no neighbour of their key comes near need no fold; a pause longer than the window also ends a fold's run.
    """
    from .folds import Dedupe, ordered_fold

    order = Window.partitionBy("title_id", "key").orderBy("start_ms", "seq")
    keyed = events.where("key is not null").select("title_id", "key", "seq", "start_ms", F.coalesce("end_ms", "start_ms").alias("end_ms"))
    new = F.when(C("start_ms") - F.lag("start_ms").over(order) <= window_ms, 0).otherwise(1)
    runs = keyed.withColumn("_new", new).withColumn("run", F.sum("_new").over(order)).withColumn("_alone", (C("_new") == 1) & (F.coalesce(F.lead("_new").over(order), F.lit(1)) == 1))
    alone = runs.where("_alone").select("title_id", "key", "seq", "start_ms", "end_ms", F.lit(1).cast("long").alias("merged"))
    folded = ordered_fold(runs.where("not _alone").drop("_new", "_alone"), ["title_id", "key", "run"], ["start_ms", "seq"], lambda: Dedupe(window_ms), "title_id long, key string, run long, seq long, start_ms long, end_ms long, merged long").drop("run")
    free = events.where("key is null").select("title_id", F.lit(None).cast("string").alias("key"), "seq", "start_ms", F.coalesce("end_ms", "start_ms").alias("end_ms"), F.lit(1).cast("long").alias("merged"))
    return alone.unionByName(folded).unionByName(free)


def upsert_by_id(rows: DataFrame, id_: str, order: str) -> DataFrame:
    """One row for each id: of every field the last value that is not null."""
    fields = [c for c in rows.columns if c not in (id_, order)]
    return rows.groupBy(id_).agg(*[F.max_by(c, F.when(C(c).isNotNull(), C(order))).alias(c) for c in fields])


def retain_top(rows: DataFrame, score: Column, most: int) -> DataFrame:
    """The ``most`` rows of each title with the greatest scores; on ties the latest stay."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("title_id").orderBy(score.desc(), F.desc("start_ms"), F.desc("seq")))).where(C("_n") <= most).drop("_n")


def evict(rows: DataFrame, score: Column, most: int) -> DataFrame:
    """title_id, seq of what a store of ``most`` rows a title holds after all rows came in the order of seq.

    Whenever a title is over its limit, a tenth of the limit goes: the least scores, of equal ones the earliest. The store is the
    state of one fold, ``most`` rows at most.
    """
    from .folds import Evict, ordered_fold

    scored = rows.select("title_id", "seq", "start_ms", score.cast("double").alias("score"))
    kind = rows.schema["title_id"].dataType.simpleString()
    return ordered_fold(scored, ["title_id"], ["seq"], lambda: Evict(most), f"title_id {kind}, seq long")


def find_silences(regions: DataFrame, least_ms: int = 1200, long_ms: int = 4000, factor: float = 3, around: int = 6) -> DataFrame:
    """title_id, start_ms, end_ms, gap_ms, significant: pauses between regions, measured against the median of the pauses around."""
    order = per_title("start_ms", "end_ms")
    gaps = regions.select("title_id", F.lag("end_ms").over(order).alias("s"), C("start_ms").alias("e"), "end_ms").where("s is not null").withColumn("gap", C("e") - C("s"))
    positive = F.when(C("gap") > 0, C("gap"))
    line = per_title("e", "end_ms")
    near = F.concat(F.collect_list(positive).over(line.rowsBetween(-around, -1)), F.collect_list(positive).over(line.rowsBetween(1, around)))
    n = gaps.withColumn("_near", F.array_sort(near))
    half = F.floor(F.size("_near") / 2).cast("int")
    median = F.when(F.size("_near") == 0, C("gap")).when(F.size("_near") % 2 == 1, F.get("_near", half)).otherwise((F.get("_near", half - 1) + F.get("_near", half)) / 2)
    out = n.withColumn("_median", median).where(C("gap") >= least_ms)
    return out.select("title_id", C("s").alias("start_ms"), C("e").alias("end_ms"), C("gap").alias("gap_ms"), ((C("gap") >= long_ms) | (C("gap") >= factor * C("_median"))).alias("significant"))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def frame_metrics(frames: DataFrame, width: int = 32, height: int = 18, block: int = 4) -> DataFrame:
    """frames (title_id, seq, at_ms, luma) with metrics against the frame before; each title's first frame goes."""
    from .scanner import METRICS, scan_frames

    return scan_frames(frames, width, height, block=block).where("frame_difference is not null").select("title_id", "seq", "at_ms", *METRICS)


def edge_energy(luma: Column, width: int, height: int, x: float, y: float, w: float, h: float) -> Column:
    """Contrast of neighbours in a row within a part of the grid, at most 1."""
    from math import ceil, floor

    cells = [r * width + c + 1 for r in range(floor(y * height), min(height, ceil((y + h) * height))) for c in range(floor(x * width), min(width, ceil((x + w) * width)) - 1)]
    return F.least(F.lit(1.0), _sum(F.transform(F.array(*map(F.lit, cells)), lambda i: F.abs(F.element_at(luma, i) - F.element_at(luma, i + 1)).cast("double"))) / (len(cells) * 96.0))


def importance(metrics: DataFrame) -> DataFrame:
    """Adds importance: weighted changes, more right after a cut and near captions, speech, sounds or seeks (boolean columns, where there are any).

    A column static_streak, the number of unchanged frames before, makes long streaks count less. Null metrics are 0, a null luminance is not dark.
    """
    # fixed values: weights of the metrics, boosts and decays
    base = sum((F.coalesce(C(c), F.lit(0.0)) * w for c, w in (("motion", 0.25), ("cut", 0.35), ("text_change", 0.15), ("face_change", 0.1))), F.coalesce("frame_difference", F.lit(0.0)) * 0.15)
    last_cut = F.last(F.when(C("cut") >= 0.6, C("at_ms")), ignorenulls=True).over(per_title("at_ms", "seq").rowsBetween(Window.unboundedPreceding, 0))
    m = metrics.withColumn("_since", C("at_ms") - last_cut)
    score = F.least(F.lit(1.0), base * 1.6) + F.when(C("_since") <= 1500, 0.2 * (1 - C("_since") / 1500)).otherwise(0.0)
    for name, boost in (("near_subtitle", 0.12), ("near_speech", 0.15), ("near_sound", 0.12), ("seek", 0.25)):
        if name in metrics.columns:
            score = score + F.when(C(name), boost).otherwise(0.0)
    if "static_streak" in metrics.columns:
        score = score * F.when(C("static_streak") > 5, F.greatest(F.lit(0.25), 1 - (C("static_streak") - 5) * 0.06)).otherwise(1.0)
    dark = (F.coalesce("luminance", F.lit(1.0)) < 0.02) & (F.coalesce("cut", F.lit(0.0)) < 0.5)
    score = F.when(dark, score * 0.3).otherwise(score)
    return m.withColumn("importance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop("_since")


def scan(frames: DataFrame, width: int = 32, height: int = 18, least: float = 0.08) -> DataFrame:
    """Temporal events: frame metrics, without redundant ones, of at least ``least`` importance.

    A frame that is no longer redundant has ended the streak of still frames, so no streak lowers an event's importance.
    """
    from .scanner import METRICS, scan_frames

    return scan_frames(frames, width, height, least).where("event").select("title_id", "seq", "at_ms", *METRICS, "importance")


def hesitations(events: DataFrame, still: float = 0.06, least_ms: int = 250) -> DataFrame:
    """title_id, start_ms, end_ms of still runs strictly between two motions."""
    order = per_title("at_ms", "seq")
    m = events.withColumn("_moves", C("motion") > still)
    before = F.last(F.when(C("_moves"), C("at_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = m.withColumns({"_before": before, "_was": F.lag("_moves").over(order)}).withColumn("_starts", ~C("_moves") & C("_was"))
    start = F.last(F.when(C("_starts"), C("at_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = run.withColumn("start_ms", start).where(C("_moves") & ~C("_was") & C("_before").isNotNull())
    return out.select("title_id", "start_ms", C("at_ms").alias("end_ms")).where(C("end_ms") - C("start_ms") >= least_ms)


def select_windows(windows: DataFrame, budget: int) -> DataFrame:
    """Of each title ``budget`` windows: the best of each of as many equal parts of its span, then the best of the rest."""
    mid = (C("start_ms") + C("end_ms")) / 2
    span = windows.groupBy("title_id").agg(F.min("start_ms").alias("_low"), F.max("end_ms").alias("_high"))
    w = windows.join(span, "title_id").withColumn("_part", F.least(F.lit(budget - 1), F.floor((mid - C("_low")) * budget / F.greatest(F.lit(1), C("_high") - C("_low")))))
    best = F.row_number().over(Window.partitionBy("title_id", "_part").orderBy(F.desc("importance"), "start_ms", "seq"))
    w = w.withColumn("_first", best == 1)
    place = F.row_number().over(Window.partitionBy("title_id").orderBy(F.desc("_first"), F.desc("importance"), "start_ms", "seq"))
    return w.withColumn("_n", place).where(C("_n") <= budget).select(*windows.columns)


def even_sample(rows: DataFrame, k: int) -> DataFrame:
    """k rows of each title at rounded even steps."""
    n = F.count("*").over(Window.partitionBy("title_id"))
    r = rows.withColumns({"_i": F.row_number().over(per_title("at_ms", "seq")) - 1, "_n": n})
    picks = F.when(C("_n") <= k, F.lit(True)).otherwise(F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (C("_n") - 1) / F.lit(max(1, k - 1)) + 0.5) == C("_i")))
    return r.where(picks).drop("_i", "_n")


def overview_plan(durations: DataFrame, per_sheet: int = 30, sheets: int = 8, least: int = 2000) -> DataFrame:
    """title_id, sheet, at_ms: tiles at even steps that need ``sheets`` sheets at most."""
    raw = C("duration_ms") / (per_sheet * sheets)
    d = durations.where("duration_ms > 0").withColumn("step", F.greatest(F.lit(least), F.ceil(raw / 500) * 500)).withColumn("begin", F.least(C("step") / 2, C("duration_ms") / 2))
    count = F.ceil((C("duration_ms") - C("begin")) / C("step"))
    tiles = d.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), count - 1))))
    return tiles.withColumn("sheet", F.floor(C("i") / per_sheet)).where(C("sheet") < sheets).select("title_id", "sheet", F.floor(C("begin") + C("i") * C("step") + 0.5).cast("long").alias("at_ms"))


def seeks(samples: DataFrame, least_ms: int = 1000) -> DataFrame:
    """Jumps of more than ``least_ms`` between neighbouring samples: title_id, seq, from_ms, to_ms."""
    s = samples.withColumn("from_ms", F.lag("media_ms").over(per_title("at_ms", "seq")))
    return s.where(F.abs(C("media_ms") - C("from_ms")) > least_ms).select("title_id", "seq", "from_ms", C("media_ms").alias("to_ms"))


def continuity(rows: DataFrame, jump: Column) -> DataFrame:
    """rows with segment, the number of jumps (seeks) of their title so far: folds keyed by it begin anew at each jump."""
    return rows.withColumn("segment", F.sum(F.when(jump, 1).otherwise(0)).over(per_title("at_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)))


def status(events: DataFrame) -> DataFrame:
    """title_id, events, ratio (share of the title that events cover), per_minute (events for each minute between the first and the last start)."""
    from .intervals import covered_duration

    spans = events.groupBy("title_id").agg(F.count("*").alias("events"), F.max(F.coalesce("end_ms", "start_ms")).alias("_end"), ((F.max("start_ms") - F.min("start_ms")) / 60_000).alias("_minutes"))
    covered = covered_duration(events).withColumnRenamed("title_id", "_title")
    out = spans.join(covered.hint("merge"), C("title_id").eqNullSafe(C("_title")), "left")
    ratio = F.when(C("_end") > 0, F.least(F.lit(1.0), F.coalesce("covered_ms", F.lit(0)) / C("_end")))
    return out.select("title_id", "events", ratio.alias("ratio"), F.when(C("_minutes") > 0, C("events") / C("_minutes")).alias("per_minute"))


def recent(rows: DataFrame, horizon_ms: int, most: int, bytes_: int) -> DataFrame:
    """The newest rows of each title: within the horizon of its last, ``most`` at most, ``bytes_`` (column size) in sum."""
    newest = Window.partitionBy("title_id").orderBy(F.desc("at_ms"), F.desc("seq"))
    w = rows.withColumns({"_last": F.max("at_ms").over(Window.partitionBy("title_id")), "_n": F.row_number().over(newest), "_b": F.sum("size").over(newest.rowsBetween(Window.unboundedPreceding, 0))})
    return w.where((C("at_ms") >= C("_last") - horizon_ms) & (C("_n") <= most) & (C("_b") <= bytes_)).drop("_last", "_n", "_b")


def changes(rows: DataFrame, value: str) -> DataFrame:
    """Rows whose value differs from the one before in their title."""
    return rows.withColumn("_p", F.lag(value).over(per_title("at_ms", "seq"))).withColumn("_f", F.row_number().over(per_title("at_ms", "seq"))).where((C("_f") == 1) | ~C(value).eqNullSafe(C("_p"))).drop("_p", "_f")
