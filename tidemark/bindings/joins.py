"""Joins of events over time: matches, conflicts, context, promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..plans import fusion
from ..registry import query
from .views import EV, WITH, evidence, table

C = F.col
HOUR = 3_600_000
BUCKET = HOUR


def cues(spark, sf_dir):
    """Views as cues and clicks as transcripts; each says one of five words by its k."""
    e = evidence(spark, sf_dir)
    said = F.element_at(F.array(*map(F.lit, ["hello there", "hello where", "good night", "good nights", "farewell"])), (C("k") % 5 + 1).cast("int"))
    e = e.withColumns({"text": said, "language": F.lit("en")})
    cols = ["title_id", "seq", "start_ms", "end_ms", "text", "language", "confidence"]
    return e.where("source = 'view'").select(*cols), e.where("source = 'click'").select(*cols)


_SAY = "CASE k % 5 WHEN 0 THEN 'hello there' WHEN 1 THEN 'hello where' WHEN 2 THEN 'good night' WHEN 3 THEN 'good nights' ELSE 'farewell' END"
_IOU = "(least(c.end_ms, a.end_ms) - greatest(c.start_ms, a.start_ms)) / CAST(greatest(c.end_ms, a.end_ms) - least(c.start_ms, a.start_ms) AS DOUBLE)"
_PAIRS = f"""{EV}, c AS (SELECT *, {_SAY} AS text FROM ev WHERE source = 'view'), a AS (SELECT *, {_SAY} AS text FROM ev WHERE source = 'click'),
pr AS (SELECT c.seq, a.seq AS asr_seq, c.start_ms AS cs, {_IOU} AS iou, CASE WHEN c.text = a.text THEN 1.0 ELSE 1 - levenshtein(c.text, a.text) / CAST(greatest(length(c.text), length(a.text)) AS DOUBLE) END AS similarity FROM c JOIN a ON a.title_id = c.title_id AND c.start_ms < a.end_ms AND a.start_ms < c.end_ms),
mt AS (SELECT seq, asr_seq, iou, similarity FROM pr WHERE iou >= 0.25 AND similarity >= 0.6),
cf AS (SELECT asr_seq, arg_min(seq, cs * 1000000 + seq) AS seq FROM pr WHERE iou > 0.25 AND asr_seq NOT IN (SELECT asr_seq FROM mt) GROUP BY asr_seq)"""


@query(f"WITH {_PAIRS} SELECT seq, asr_seq, iou, round(similarity, 9) AS similarity FROM mt")
def j3_match_transcripts(spark, sf_dir):
    return fusion.match_transcripts(*cues(spark, sf_dir), BUCKET).withColumn("similarity", F.round("similarity", 9))


@query(f"WITH {_PAIRS} SELECT asr_seq, seq FROM cf")
def j4_conflicts(spark, sf_dir):
    c, a = cues(spark, sf_dir)
    return fusion.conflicts(c, a, fusion.match_transcripts(c, a, BUCKET), BUCKET)


@query(f"WITH {_PAIRS} SELECT seq FROM a WHERE seq NOT IN (SELECT asr_seq FROM mt) AND seq NOT IN (SELECT asr_seq FROM cf)")
def j5_recovered_transcripts(spark, sf_dir):
    c, a = cues(spark, sf_dir)
    m = fusion.match_transcripts(c, a, BUCKET)
    return fusion.recovered(a, m, fusion.conflicts(c, a, m, BUCKET)).select("seq")


def _at(e, source):
    return e.where(C("source") == source).select("title_id", "seq", C("start_ms").alias("at_ms"))


def _moments(e, source):
    return e.where(C("source") == source).select("title_id", C("seq").alias("r_seq"), C("start_ms").alias("r_at"), "k")


@query(f"""WITH {EV}, p AS (SELECT l.seq, r.seq AS r_seq, row_number() OVER (PARTITION BY l.seq ORDER BY r.start_ms DESC, r.seq DESC) AS n FROM ev l JOIN ev r ON r.title_id = l.title_id AND l.source = 'purchase' AND r.source = 'view' AND r.start_ms < l.start_ms AND l.start_ms - r.start_ms <= {12 * HOUR})
SELECT seq, string_agg(CAST(r_seq AS VARCHAR), ',' ORDER BY n) AS recent FROM p WHERE n <= 3 GROUP BY seq""")
def j14_context_as_of(spark, sf_dir):
    """Of each purchase the three newest views strictly before it, twelve hours back at most."""
    e = evidence(spark, sf_dir)
    return joins.top_before(_at(e, "purchase"), _moments(e, "view"), 12 * HOUR, 3, strict=True).select("seq", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("recent"))


@query(f"""WITH {EV}, p AS (SELECT w.seq, d.seq AS d_seq, greatest(d.start_ms, w.start_ms) AS at_ms, row_number() OVER (PARTITION BY w.seq ORDER BY d.start_ms, d.seq) AS n FROM ev w JOIN ev d ON d.title_id = w.title_id AND w.source = 'purchase' AND d.source = 'view' AND d.start_ms < w.end_ms AND d.end_ms >= w.start_ms - {HOUR // 2})
SELECT seq, d_seq, at_ms FROM p WHERE n <= 12""")
def j15_dialogue_in_window(spark, sf_dir):
    from ..plans.requests import dialogue_in_window

    e = evidence(spark, sf_dir)
    w = e.where("source = 'purchase'").select("title_id", "seq", "start_ms", "end_ms")
    d = e.where("source = 'view'").select("title_id", C("seq").alias("r_seq"), C("start_ms").alias("r_start"), C("end_ms").alias("r_end"))
    return dialogue_in_window(w, d, HOUR, lead_ms=HOUR // 2).select("seq", C("r_seq").alias("d_seq"), "at_ms")


@query(f"""WITH {EV}, p AS (SELECT w.seq, d.seq AS d_seq, least(w.end_ms, greatest(w.start_ms, d.start_ms)) AS at_ms, row_number() OVER (PARTITION BY w.seq ORDER BY d.start_ms, d.seq) AS n FROM ev w JOIN ev d ON d.title_id = w.title_id AND w.source = 'purchase' AND d.source = 'click' AND d.start_ms < w.end_ms AND d.end_ms >= w.start_ms)
SELECT seq, d_seq, at_ms FROM p WHERE n <= 12""")
def j15_sounds_in_window(spark, sf_dir):
    from ..plans.requests import sounds_in_window

    e = evidence(spark, sf_dir)
    w = e.where("source = 'purchase'").select("title_id", "seq", "start_ms", "end_ms")
    d = e.where("source = 'click'").select("title_id", C("seq").alias("r_seq"), C("start_ms").alias("r_start"), C("end_ms").alias("r_end"))
    return sounds_in_window(w, d, HOUR).select("seq", C("r_seq").alias("d_seq"), "at_ms")


@query(f"""WITH {EV}, b AS (SELECT w.seq, max(m.k / 100.0) AS best FROM ev w JOIN ev m ON m.title_id = w.title_id AND w.source = 'view' AND m.source = 'click' AND m.start_ms >= w.start_ms - {HOUR} AND m.start_ms <= w.end_ms + {HOUR} GROUP BY w.seq)
SELECT ev.seq, greatest(value / 500, coalesce(best, 0.0)) AS importance FROM ev LEFT JOIN b ON b.seq = ev.seq WHERE source = 'view'""")
def j16_promote_windows(spark, sf_dir):
    e = evidence(spark, sf_dir)
    w = e.where("source = 'view'").select("title_id", "seq", "start_ms", "end_ms", (C("value") / 500).alias("importance"))
    m = e.where("source = 'click'").select("title_id", C("start_ms").alias("r_at"), (C("k") / 100).alias("weight"))
    return joins.promote(w, m, HOUR).select("seq", "importance")


@query(f"{WITH} SELECT seq FROM ev m WHERE source = 'click' AND NOT EXISTS (SELECT 1 FROM ev w WHERE w.title_id = m.title_id AND w.source = 'view' AND m.start_ms BETWEEN w.start_ms AND w.end_ms)")
def j17_uncovered_moments(spark, sf_dir):
    e = evidence(spark, sf_dir)
    w = e.where("source = 'view'").select("title_id", C("start_ms").alias("r_start"), C("end_ms").alias("r_end"))
    return joins.uncovered(_at(e, "click"), w, HOUR).select("seq")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def j18_dimension_lookup(spark, sf_dir):
    """Nations and regions are fixed small tables, so they are broadcast."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), C("n_regionkey") == C("r_regionkey"))
    return table(spark, sf_dir, "customer").join(F.broadcast(n), C("c_nationkey") == C("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query(f"""{WITH}, ids AS (SELECT seq, unnest([k, k + 7, user_id]) AS id, unnest([0, 1, 2]) AS pos FROM ev), a AS (SELECT DISTINCT k AS id FROM ev WHERE source = 'signup' AND k % 3 = 0)
SELECT ev.seq, arg_min('character-' || CAST(a.id AS VARCHAR), pos) AS character_id FROM ev LEFT JOIN ids ON ids.seq = ev.seq LEFT JOIN a ON a.id = ids.id GROUP BY ev.seq""".replace("arg_min('character-' || CAST(a.id AS VARCHAR), pos)", "arg_min(CASE WHEN a.id IS NOT NULL THEN 'character-' || CAST(a.id AS VARCHAR) END, CASE WHEN a.id IS NOT NULL THEN pos END)"))
def j19_user_assignment(spark, sf_dir):
    e = evidence(spark, sf_dir)
    beats = e.select("seq", F.array("k", C("k") + 7, "user_id").alias("evidence_ids"))
    a = e.where("source = 'signup' and k % 3 = 0").select(C("k").alias("evidence_id"), F.concat(F.lit("character-"), C("k").cast("string")).alias("character_id")).distinct()
    return joins.assign_by_first(beats, a).select("seq", "character_id")


@query(f"""WITH {EV}, p AS (SELECT s.seq, f.seq AS f_seq, f.start_ms, row_number() OVER (PARTITION BY s.seq ORDER BY f.start_ms, f.seq) AS n FROM ev s JOIN ev f ON f.title_id = s.title_id AND s.source = 'view' AND f.source = 'click' AND f.start_ms BETWEEN s.start_ms AND s.end_ms)
SELECT seq, string_agg(CAST(f_seq AS VARCHAR), ',' ORDER BY n) AS frames FROM p WHERE n <= 4 GROUP BY seq""")
def j20_frame_refs(spark, sf_dir):
    e = evidence(spark, sf_dir)
    s = e.where("source = 'view'").select("title_id", "seq", "start_ms", "end_ms")
    return joins.frame_refs(s, _moments(e, "click"), HOUR).select("seq", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@query(f"{WITH} SELECT s.seq AS scene_seq, e.seq FROM ev s JOIN ev e ON s.source = 'signup' AND (e.seq = s.seq + 1 OR (e.title_id = s.title_id AND e.start_ms BETWEEN s.start_ms AND s.end_ms))")
def j21_drill_down(spark, sf_dir):
    e = evidence(spark, sf_dir)
    scenes = e.where("source = 'signup'").select("title_id", "seq", "start_ms", "end_ms", F.array(C("seq") + 1).alias("evidence_ids"))
    return joins.drill_down(scenes, e, HOUR)
