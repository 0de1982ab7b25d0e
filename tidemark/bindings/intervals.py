"""Interval unions, gaps and coverage over the events' titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals
from ..registry import query
from .views import EV, evidence

C = F.col


def _islands(tolerance: int, name: str = "merged") -> str:
    return f"""{name}_r AS (SELECT *, max(end_ms) OVER (PARTITION BY title_id ORDER BY start_ms, end_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev),
{name}_i AS (SELECT *, sum(CASE WHEN start_ms <= reach + {tolerance} THEN 0 ELSE 1 END) OVER (PARTITION BY title_id ORDER BY start_ms, end_ms, seq) AS island FROM {name}_r),
{name} AS (SELECT title_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM {name}_i GROUP BY title_id, island)"""


def durations(ev):
    return ev.groupBy("title_id").agg((F.max("end_ms") + 60000).alias("duration_ms"))


@query(f"WITH {EV}, {_islands(0)} SELECT * FROM merged")
def a1_merge_ranges(spark, sf_dir):
    return intervals.merge_ranges(evidence(spark, sf_dir))


@query(f"WITH {EV}, {_islands(600000)} SELECT * FROM merged")
def a1_merge_ranges_tolerance(spark, sf_dir):
    return intervals.merge_ranges(evidence(spark, sf_dir), 600000)


@query(f"WITH {EV}, {_islands(0)} SELECT title_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS covered_ms FROM merged GROUP BY title_id")
def a2_covered_duration(spark, sf_dir):
    return intervals.covered_duration(evidence(spark, sf_dir))


_DUR = "d AS (SELECT title_id, max(end_ms) + 60000 AS duration_ms FROM ev GROUP BY title_id)"
_GAPS = f"""{_DUR}, c AS (SELECT m.title_id, greatest(start_ms, 0) AS s, least(end_ms, duration_ms) AS e FROM merged m JOIN d USING (title_id) UNION ALL SELECT title_id, duration_ms, duration_ms FROM d),
p AS (SELECT title_id, coalesce(max(e) OVER (PARTITION BY title_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms, s AS end_ms FROM c),
gaps AS (SELECT * FROM p WHERE end_ms > start_ms)"""


@query(f"WITH {EV}, {_islands(0)}, {_GAPS} SELECT * FROM gaps")
def a3_invert_ranges(spark, sf_dir):
    e = evidence(spark, sf_dir)
    return intervals.invert_ranges(intervals.merge_ranges(e), durations(e))


_TC = "(CASE WHEN {0} >= 3600000 THEN CAST({0} // 3600000 AS VARCHAR) || ':' || lpad(CAST({0} % 3600000 // 60000 AS VARCHAR), 2, '0') ELSE CAST({0} // 60000 AS VARCHAR) END || ':' || lpad(CAST({0} % 60000 // 1000 AS VARCHAR), 2, '0'))"


@query(f"""WITH {EV}, {_islands(250)}, {_GAPS}, s AS (SELECT title_id, count(*) AS observed, CAST(sum(end_ms - start_ms) AS BIGINT) AS covered_ms FROM merged GROUP BY title_id),
g AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY start_ms) AS n FROM gaps),
t AS (SELECT title_id, count(*) AS gaps, string_agg(CASE WHEN n <= 20 THEN {_TC.format('start_ms')} || ' to ' || {_TC.format('end_ms')} END, '; ' ORDER BY n) AS first FROM g GROUP BY title_id)
SELECT title_id, duration_ms, observed, covered_ms, least(1.0, covered_ms / CAST(duration_ms AS DOUBLE)) AS ratio, gaps, first || CASE WHEN gaps > 20 THEN '; and ' || CAST(gaps - 20 AS VARCHAR) || ' more' ELSE '' END AS notes FROM d JOIN s USING (title_id) JOIN t USING (title_id)""")
def a4_coverage_report(spark, sf_dir):
    e = evidence(spark, sf_dir)
    return intervals.coverage_report(e, durations(e)).withColumn("notes", F.array_join("notes", "; "))


def _side(e, source):
    return e.where(C("source") == source).select("title_id", C("seq").alias("r_seq"), C("start_ms").alias("r_start"), C("end_ms").alias("r_end"))


BUCKET = 3_600_000
CLICKS = "l AS (SELECT * FROM ev WHERE source = 'click'), r AS (SELECT * FROM ev WHERE source = 'view')"


@query(f"WITH {EV}, {CLICKS} SELECT l.seq, r.seq AS r_seq FROM l JOIN r ON l.title_id = r.title_id AND l.start_ms < r.end_ms AND r.start_ms < l.end_ms")
def j1_overlap_join(spark, sf_dir):
    e = evidence(spark, sf_dir)
    return intervals.overlap_join(e.where("source = 'click'"), _side(e, "view"), BUCKET).select("seq", "r_seq")


@query(f"WITH {EV}, {CLICKS} SELECT l.seq, count(r.seq) AS hits FROM l JOIN r ON l.title_id = r.title_id AND r.start_ms < l.end_ms AND r.end_ms >= l.start_ms GROUP BY l.seq")
def j2_range_lookup(spark, sf_dir):
    e = evidence(spark, sf_dir)
    return intervals.overlap_join(e.where("source = 'click'"), _side(e, "view"), BUCKET, closed=True).groupBy("seq").agg(F.count("*").alias("hits"))


_IOU = "(least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)) / CAST(greatest(l.end_ms, r.end_ms) - least(l.start_ms, r.start_ms) AS DOUBLE)"


@query(f"""WITH {EV}, {CLICKS}, p AS (SELECT l.seq, r.seq AS r_seq, r.user_id, {_IOU} AS iou, r.start_ms AS rs FROM l JOIN r ON l.title_id = r.title_id AND l.start_ms < r.end_ms AND r.start_ms < l.end_ms)
SELECT seq, r_seq, iou FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY iou DESC, rs, r_seq) AS n FROM p WHERE iou > 0.1) WHERE n = 1""")
def j6_best_speaker_iou(spark, sf_dir):
    from ..operators.joins import best_overlap

    e = evidence(spark, sf_dir)
    return best_overlap(e.where("source = 'click'"), _side(e, "view"), BUCKET, least_iou=0.1).select("seq", "r_seq", "iou")


@query(f"""WITH {EV}, {CLICKS}, p AS (SELECT l.seq, r.seq AS r_seq, least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms) AS ms, r.start_ms AS rs FROM l JOIN r ON l.title_id = r.title_id AND l.start_ms < r.end_ms AND r.start_ms < l.end_ms)
SELECT seq, r_seq, ms FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ms DESC, rs, r_seq) AS n FROM p) WHERE n = 1""")
def j7_best_speaker_ms(spark, sf_dir):
    from ..operators.joins import best_overlap

    e = evidence(spark, sf_dir)
    return best_overlap(e.where("source = 'click'"), _side(e, "view"), BUCKET).select("seq", "r_seq", "ms")


@query(f"WITH {EV} SELECT seq FROM ev l WHERE source = 'error' AND NOT EXISTS (SELECT 1 FROM ev r WHERE r.source = 'signup' AND r.title_id = l.title_id AND abs(r.start_ms - l.start_ms) < 1200000)")
def j8_sound_suppression(spark, sf_dir):
    from ..operators.joins import suppress_near

    e = evidence(spark, sf_dir)
    at = lambda s: e.where(C("source") == s)
    return suppress_near(at("error").select("title_id", "seq", C("start_ms").alias("at_ms")), at("signup").select("title_id", C("start_ms").alias("r_at")), 1200000).select("seq")


@query(f"""WITH {EV}, {CLICKS} SELECT l.seq, r.seq AS r_seq, (least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)) / CAST(least(l.end_ms - l.start_ms, r.end_ms - r.start_ms) AS DOUBLE) AS strength
FROM l JOIN r ON l.title_id = r.title_id AND l.start_ms < r.end_ms AND r.start_ms < l.end_ms WHERE (least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)) / CAST(least(l.end_ms - l.start_ms, r.end_ms - r.start_ms) AS DOUBLE) >= 0.25""")
def j9_align_pairs(spark, sf_dir):
    from ..operators.joins import align_pairs

    e = evidence(spark, sf_dir)
    return align_pairs(e.where("source = 'click'"), _side(e, "view"), BUCKET, points=True).select("seq", "r_seq", "strength")


@query(f"""WITH {EV}, s AS (SELECT title_id, start_ms AS at_ms, seq, k FROM ev WHERE source = 'view'), q AS (SELECT title_id, start_ms AS at_ms, seq FROM ev WHERE source = 'click'),
p AS (SELECT q.*, s.at_ms AS r_at_ms, s.k, row_number() OVER (PARTITION BY q.seq ORDER BY s.at_ms DESC, s.seq DESC) AS n FROM q JOIN s ON q.title_id = s.title_id AND s.at_ms <= q.at_ms)
SELECT seq, CASE WHEN at_ms - r_at_ms <= 36000000 THEN CASE WHEN k % 2 = 0 THEN r_at_ms + CAST(floor((at_ms - r_at_ms) * 1.5 + 0.5) AS BIGINT) ELSE r_at_ms END END AS media_ms FROM p WHERE n = 1""")
def j11_media_clock(spark, sf_dir):
    """Views are player samples: those with an even k play at 1.5 times the speed, others are paused."""
    from ..operators.joins import media_time_at

    e = evidence(spark, sf_dir)
    samples = e.where("source = 'view'").select("title_id", "seq", C("start_ms").alias("at_ms"), C("start_ms").alias("media_ms"), (C("k") % 2 == 0).alias("playing"), F.lit(1.5).alias("rate"))
    asked = e.where("source = 'click'").select("title_id", "seq", C("start_ms").alias("at_ms"))
    return media_time_at(asked, samples, 36_000_000).where("r_at_ms is not null").select("seq", "media_ms")


@query(f"""WITH {EV}, p AS (SELECT l.seq, r.seq AS r_seq, abs(r.start_ms - l.start_ms) AS d, r.start_ms AS rs FROM ev l JOIN ev r ON l.title_id = r.title_id AND l.source = 'click' AND r.source = 'view' AND abs(r.start_ms - l.start_ms) <= 1800000)
SELECT seq, r_seq FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY d, rs, r_seq) AS n FROM p) WHERE n = 1""")
def j12_nearest(spark, sf_dir):
    from ..operators.joins import nearest

    e = evidence(spark, sf_dir)
    at = lambda s: e.where(C("source") == s)
    return nearest(at("click").select("title_id", "seq", C("start_ms").alias("at_ms")), at("view").select("title_id", C("seq").alias("r_seq"), C("start_ms").alias("r_at")), 1800000).select("seq", "r_seq")


@query(f"""WITH {EV}, p AS (SELECT l.seq, r.seq AS line_seq, row_number() OVER (PARTITION BY l.seq ORDER BY r.start_ms DESC, r.seq DESC) AS n FROM ev l JOIN ev r ON l.title_id = r.title_id AND l.source = 'purchase' AND r.source = 'view' AND r.start_ms <= l.start_ms)
SELECT l.seq, p.line_seq FROM ev l LEFT JOIN p ON l.seq = p.seq AND p.n = 1 WHERE l.source = 'purchase'""")
def j13_active_line(spark, sf_dir):
    e = evidence(spark, sf_dir)
    lines = e.where("source = 'view'").select("title_id", "seq", C("start_ms").alias("at_ms"), C("seq").alias("line_seq"))
    asked = e.where("source = 'purchase'").select("title_id", "seq", C("start_ms").alias("at_ms"))
    return intervals.as_of(asked, lines, ["line_seq"]).select("seq", C("r_line_seq").alias("line_seq"))


