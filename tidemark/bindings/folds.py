"""Stateful rules over the events and the embeddings, with recursive SQL; w20 and j9 are held against plain loops, w38 against cases made by hand."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.confidence import confidence_rank
from ..functions.text import comparable_ascii
from ..operators import folds, intervals, sequences
from ..operators.folds import ordered_fold
from ..registry import query
from . import recursions
from .views import EV, WITH, evidence, evidence_of, media, table

C = F.col
HOUR = 3_600_000


def observations(spark, sf_dir):
    """Clicks as temporal events: importance and motion from their value, cuts from large ones; one step a minute."""
    e = evidence(spark, sf_dir)
    return e.select("title_id", "seq", F.floor(C("start_ms") / 60000).alias("at_ms"), F.least(F.lit(1.0), C("value") / 40).alias("importance"), F.least(F.lit(1.0), C("value") / 80).alias("motion"), F.when(C("k") % 10 == 0, 0.7).otherwise(0.1).alias("cut"))


@query(recursions.WINDOWS)
def w4_adaptive_windows(spark, sf_dir):
    """Hard cuts at scene changes and seeks; longer stretches are parted in pauses of speech."""
    from ..plans.windows import adaptive_windows

    return adaptive_windows(media(spark, sf_dir), longest=12 * HOUR, target=4 * HOUR, shortest=HOUR // 2, gap=HOUR)


@query(recursions.ATTRIBUTION)
def w13_w14_attribution(spark, sf_dir):
    from ..plans.fusion import attribute

    m = media(spark, sf_dir).where("source = 'subtitle'")
    who = F.concat(F.lit("character-"), (C("user_id") % 3).cast("string"))
    present = F.when(C("k") % 2 == 0, F.array(F.lit("character-0"), F.lit("character-1"))).otherwise(F.array(F.lit("character-2")))
    rows = m.select("title_id", "seq", C("start_ms").alias("at_ms"), F.when(C("k") % 4 == 1, who).alias("label"), F.when(C("k") % 10 == 2, who).alias("assigned"), F.when(C("k") % 10 == 4, who).alias("diarized"), F.lit(False).alias("visual"), F.lit(True).alias("sure"), present.alias("present"))
    return attribute(rows)


@query(recursions.SPEECH)
def w16_speech_regions(spark, sf_dir):
    e = evidence(spark, sf_dir).select("title_id", "seq", (F.floor(C("start_ms") / 600000) * 20).alias("at_ms"), (C("value") / 4 - 60).alias("db"), (C("k") / 250.0).alias("zcr"))
    return ordered_fold(e, ["title_id"], ["at_ms", "seq"], folds.Speech, "title_id long, start_ms long, end_ms long, mean_excess_db double, peak_db double")


@query(recursions.ONSETS)
def w17_w18_onsets_and_music(spark, sf_dir):
    e = evidence(spark, sf_dir).select("title_id", "seq", (F.floor(C("start_ms") / 600000) * 32).alias("at_ms"), (C("value") / 4 - 45).alias("level"), (C("k") / 300.0).alias("flatness"), (C("k") * 30.0).alias("centroid"), (C("value") / 10).alias("flux"), F.lit(40.0).alias("spectrum_sum"))
    return ordered_fold(e, ["title_id"], ["at_ms", "seq"], folds.Onsets, "title_id long, at_ms long, kind string, prominence_db double, attack double, centroid double, flatness double")


@query()
def w20_online_clustering(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((C("vec_id") % 20).alias("title_id"), C("vec_id").alias("seq"), (C("vec_id") * 1000).alias("start_ms"), (C("vec_id") * 1000 + 800).alias("end_ms"), C("embedding").alias("feature"))
    return ordered_fold(e, ["title_id"], ["start_ms", "seq"], lambda: folds.Speakers(0.6, 0.9), "title_id long, seq long, speaker string, distance double, turn_change boolean, confidence string")


@query(recursions.SAMPLING)
def w26_adaptive_sampling(spark, sf_dir):
    return ordered_fold(observations(spark, sf_dir), ["title_id"], ["at_ms", "seq"], folds.Sampler, "title_id long, seq long, analyze boolean, reason string, tokens double, promoted boolean")


_SEG = "title_id long, start_ms long, end_ms long, events long, peak double, motion double, on_cut boolean"


@query(recursions.SEGMENTS)
def w27_action_segments(spark, sf_dir):
    return ordered_fold(observations(spark, sf_dir), ["title_id"], ["at_ms", "seq"], folds.Segments, _SEG)


@query(recursions.MERGED)
def w29_merge_segments(spark, sf_dir):
    s = w27_action_segments(spark, sf_dir).select("title_id", "start_ms", "end_ms", "peak", "motion", "on_cut")
    return ordered_fold(s, ["title_id"], ["start_ms", "end_ms", "peak", "motion", "on_cut"], lambda: folds.MergeSegments(900), "title_id long, start_ms long, end_ms long, peak double, motion double, hesitations long, segments long")


@query(recursions.SPEECH_PLAN)
def w30_speech_plan(spark, sf_dir):
    m = intervals.merge_ranges(evidence(spark, sf_dir).where("source = 'view'"), 400)
    return ordered_fold(m, ["title_id"], ["start_ms"], lambda: folds.SpeechPlan(120, 320, HOUR // 4, 400 * HOUR), "title_id long, start_ms long, end_ms long, continuation boolean, state string")


@query(recursions.DENSE_PLAN)
def w35_dense_plan(spark, sf_dir):
    e = evidence(spark, sf_dir)
    d = e.groupBy("title_id").agg(F.max("end_ms").alias("duration_ms"))
    m = e.where("source = 'click'").join(d, "title_id").select("title_id", "seq", C("start_ms").alias("at_ms"), C("value").alias("weight"), (-C("value")).alias("order"), "duration_ms")
    return ordered_fold(m, ["title_id"], ["order", "at_ms", "seq"], lambda: folds.DensePlan(12 * HOUR, HOUR, 40), "title_id long, start_ms long, end_ms long, importance double")


@query(recursions.DENSE_PLAN_GIVEN)
def w35_dense_plan_given(spark, sf_dir):
    """As w35_dense_plan; a fourth of the views are windows of six hours that are there already."""
    e = evidence(spark, sf_dir)
    d = e.groupBy("title_id").agg(F.max("end_ms").alias("duration_ms"))
    given = e.where("source = 'view' and k % 4 = 0").select("title_id", "seq", C("start_ms").alias("at_ms"), C("value").alias("weight"), F.lit(None).cast("double").alias("order"), F.lit(0).cast("long").alias("duration_ms"), (C("start_ms") + 6 * HOUR).alias("until"))
    m = e.where("source = 'click'").join(d.hint("merge"), "title_id").select("title_id", "seq", C("start_ms").alias("at_ms"), C("value").alias("weight"), (-C("value")).alias("order"), "duration_ms", F.lit(None).cast("long").alias("until"))
    return ordered_fold(given.unionByName(m), ["title_id"], ["order", "at_ms", "seq"], lambda: folds.DensePlan(12 * HOUR, HOUR, 40), "title_id long, start_ms long, end_ms long, importance double")


@query(recursions.EVICTED)
def w3_evict(spark, sf_dir):
    """What is left of the events in a store of 100 rows a title, which drops ten whenever it is over."""
    weight = F.coalesce(*[F.when(C("source") == k, v) for k, v in recursions.RETENTION.items()])
    return sequences.evict(evidence(spark, sf_dir), weight + confidence_rank(C("confidence")) * 2, 100)


@query()
def w38_accumulate_captions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    step = c.select(C("conv_id").alias("title_id"), (C("turn") * 3).alias("n"), "text", F.when(C("turn") % 5 == 4, "fr").otherwise("en").alias("language"))
    words = F.split(F.trim("text"), r"\s+")
    grown = step.select("title_id", "n", "language", F.posexplode(F.array(F.array_join(F.slice(words, 1, 3), " "), F.array_join(F.slice(words, 1, 6), " "), F.array_join(words, " "))).alias("i", "text"))
    rows = grown.select("title_id", (C("n") + C("i")).alias("seq"), ((C("n") + C("i")) * 900).alias("at_ms"), "text", comparable_ascii(C("text")).alias("comparable"), "language")
    return ordered_fold(rows, ["title_id"], ["at_ms", "seq"], folds.Captions, "title_id long, text string, start_ms long, end_ms long, language string, progressive boolean")


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT title_id, seq, start_ms AS at_ms, row_number() OVER (PARTITION BY title_id ORDER BY start_ms, seq) AS n FROM ev),
r AS (SELECT title_id, seq, n, at_ms, at_ms AS last, true AS kept FROM o WHERE n = 1 UNION ALL SELECT o.title_id, o.seq, o.n, o.at_ms, CASE WHEN o.at_ms - r.last < {2 * HOUR} THEN r.last ELSE o.at_ms END, o.at_ms - r.last >= {2 * HOUR} FROM r JOIN o ON o.title_id = r.title_id AND o.n = r.n + 1)
SELECT title_id, seq, at_ms FROM r WHERE kept""")
def w40_throttle(spark, sf_dir):
    return ordered_fold(evidence(spark, sf_dir).select("title_id", "seq", C("start_ms").alias("at_ms")), ["title_id"], ["at_ms", "seq"], lambda: folds.Throttle(4 * HOUR), "title_id long, seq long, at_ms long")


@query(recursions.CAPTURE)
def w42_capture_windows(spark, sf_dir):
    return ordered_fold(observations(spark, sf_dir), ["title_id"], ["at_ms", "seq"], lambda: folds.CaptureWindows(240, 500), "title_id long, start_ms long, end_ms long, importance double")


@query(f"{WITH}, w AS (SELECT title_id, start_ms // {4 * HOUR} AS w, value FROM ev) SELECT title_id, w * {4 * HOUR} AS start_ms, (w + 1) * {4 * HOUR} AS end_ms, greatest(0.15, max(value / 500)) AS importance FROM w GROUP BY title_id, w")
def w42_continuous_windows(spark, sf_dir):
    """Windows back to back from the start of a title: their importance is what their events raise it to."""
    w = F.floor(C("start_ms") / (4 * HOUR)).alias("w")
    return evidence(spark, sf_dir).groupBy("title_id", w).agg(F.greatest(F.lit(0.15), F.max(C("value") / 500)).alias("importance")).select("title_id", (C("w") * 4 * HOUR).alias("start_ms"), ((C("w") + 1) * 4 * HOUR).alias("end_ms"), "importance")


@query(recursions.GROUPS)
def j10_group_cues(spark, sf_dir):
    e = evidence(spark, sf_dir).where("source in ('view', 'click')").select("title_id", "seq", "start_ms", "end_ms", F.when(C("source") == "view", "en").otherwise("fr").alias("language"))
    g = ordered_fold(e, ["title_id"], ["start_ms", "seq"], folds.GroupCues, "title_id long, group long, start_ms long, end_ms long, languages array<string>, cues array<long>")
    return g.withColumns({"languages": F.array_join("languages", ","), "cues": F.array_join("cues", ",")})


@query()
def j9_p20_align_tracks(spark, sf_dir):
    from ..plans.alignment import align_tracks

    e = evidence(spark, sf_dir)
    cue = lambda s: e.where(C("source") == s).select("title_id", "seq", "start_ms", "end_ms", C("props").alias("text"))
    return align_tracks(cue("click"), cue("view"), HOUR)


@query(recursions.FORWARD)
def r10_silences_once(spark, sf_dir):
    """Stretches of views as silences: none that overlaps one given out before."""
    e = evidence(spark, sf_dir).where("source = 'view'").select("title_id", "seq", "start_ms", "end_ms")
    return ordered_fold(e, ["title_id"], ["start_ms", "seq"], folds.Forward, "title_id long, seq long, start_ms long, end_ms long")


@query(f"{WITH}, s AS (SELECT title_id, seq, start_ms, sum(CASE WHEN source = 'signup' AND k % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY title_id ORDER BY start_ms, seq ROWS UNBOUNDED PRECEDING) AS segment FROM ev), t AS (SELECT *, row_number() OVER (PARTITION BY title_id, segment ORDER BY start_ms, seq) AS n FROM s) SELECT title_id, seq, CAST(segment AS BIGINT) AS segment, n = 1 AS first FROM t")
def r8_continuity(spark, sf_dir):
    """A throttle longer than any segment gives each segment's first row: its state begins anew at a seek."""
    e = evidence(spark, sf_dir).select("title_id", "seq", C("start_ms").alias("at_ms"), "source", "k")
    rows = sequences.continuity(e, (C("source") == "signup") & (C("k") % 2 == 0)).select("title_id", "seq", "at_ms", "segment")
    first = ordered_fold(rows, ["title_id", "segment"], ["at_ms", "seq"], lambda: folds.Throttle(1 << 60), "title_id long, segment long, seq long, at_ms long")
    return rows.join(first.select("seq", F.lit(True).alias("first")).hint("merge"), "seq", "left").select("title_id", "seq", "segment", F.coalesce("first", F.lit(False)).alias("first"))


_STATUS = f"""{WITH}, v AS (SELECT *, max(end_ms) OVER (PARTITION BY title_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev WHERE source = 'click'),
i AS (SELECT *, sum(CASE WHEN start_ms <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY title_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM v), m AS (SELECT title_id, max(end_ms) - min(start_ms) AS ms FROM i GROUP BY title_id, island), c AS (SELECT title_id, sum(ms) AS ms FROM m GROUP BY title_id)
SELECT v.title_id, count(*) AS events, least(1.0, CAST(any_value(c.ms) AS DOUBLE) / max(end_ms)) AS ratio, CASE WHEN max(start_ms) > min(start_ms) THEN count(*) / ((max(start_ms) - min(start_ms)) / 60000) END AS per_minute FROM v JOIN c ON c.title_id = v.title_id GROUP BY v.title_id"""


@query(_STATUS)
def r9_status(spark, sf_dir):
    return sequences.status(evidence(spark, sf_dir).where("source = 'click'"))


@query(_STATUS)
def r9_status_stream(spark, sf_dir):
    """The same from a stream of the events: covered ranges as keyed state, changed keys written by each batch."""
    from ..operators.settle import shared_folder
    from ..streaming.stateful import live_status, read_status, status_log

    # a pattern, since a stream's path may not be one file
    path = f"{shared_folder(spark)}/status-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/{{events}}.parquet")
    clicks = evidence_of(events).where("source = 'click'")
    live_status(clicks).writeStream.outputMode("update").foreachBatch(status_log(f"{path}/log")).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return read_status(spark.read.parquet(f"{path}/log"))
