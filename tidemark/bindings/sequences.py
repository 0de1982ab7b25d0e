"""Ordered operators over the events and the embeddings (as frames)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.confidence import confidence_rank
from ..functions.labels import classify_onset
from ..operators import boundaries, intervals, scanner, sequences
from ..registry import query
from . import recursions
from .views import EV, MEDIA, WITH, evidence, frames, media, table

C = F.col
HOUR = 3_600_000
DEDUPE_MS = 7_200_000


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT title_id, source AS key, seq, start_ms, end_ms, row_number() OVER (PARTITION BY title_id, source ORDER BY start_ms, seq) AS n FROM ev),
r AS (SELECT title_id, key, n, start_ms AS anchor, seq AS kept, end_ms FROM o WHERE n = 1 UNION ALL
SELECT o.title_id, o.key, o.n, CASE WHEN o.start_ms - r.anchor <= {DEDUPE_MS} THEN r.anchor ELSE o.start_ms END, CASE WHEN o.start_ms - r.anchor <= {DEDUPE_MS} THEN r.kept ELSE o.seq END, o.end_ms FROM r JOIN o ON o.title_id = r.title_id AND o.key = r.key AND o.n = r.n + 1)
SELECT title_id, key, kept AS seq, min(anchor) AS start_ms, max(end_ms) AS end_ms, count(*) AS merged FROM r GROUP BY title_id, key, kept""")
def w1_anchored_dedupe(spark, sf_dir):
    return sequences.dedupe_events(evidence(spark, sf_dir).withColumn("key", C("source")), DEDUPE_MS)


@query(f"{WITH} SELECT k * 100 + title_id AS id, arg_max(source, seq) AS source, arg_max(CASE WHEN value > 20 THEN value END, CASE WHEN value > 20 THEN seq END) AS value FROM ev GROUP BY k * 100 + title_id")
def w2_upsert_by_id(spark, sf_dir):
    rows = evidence(spark, sf_dir).select((C("k") * 100 + C("title_id")).alias("id"), "seq", "source", F.when(C("value") > 20, C("value")).alias("value"))
    return sequences.upsert_by_id(rows, "id", "seq")


_WEIGHT = recursions.RETENTION


@query(f"{WITH}, s AS (SELECT title_id, seq, start_ms, CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _WEIGHT.items()) + " END + rank * 2 AS score FROM ev) SELECT title_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY score DESC, start_ms DESC, seq DESC) AS n FROM s) WHERE n <= 400")
def w3_retain_top(spark, sf_dir):
    weight = F.coalesce(*[F.when(C("source") == k, v) for k, v in _WEIGHT.items()])
    return sequences.retain_top(evidence(spark, sf_dir), weight + confidence_rank(C("confidence")) * 2, 400).select("title_id", "seq")


@query(f"WITH {MEDIA}, w AS (SELECT DISTINCT title_id, start_ms // {HOUR} AS window_id FROM media) SELECT w.title_id, w.window_id, count(*) AS events, coalesce(max(CASE WHEN source = 'video' THEN cut END), 0.0) AS peak FROM w JOIN media m ON m.title_id = w.title_id AND m.start_ms < (w.window_id + 1) * {HOUR} AND m.end_ms > w.window_id * {HOUR} AND source <> 'metadata' GROUP BY w.title_id, w.window_id")
def w5_window_assignment(spark, sf_dir):
    m = media(spark, sf_dir)
    windows = m.select("title_id", F.floor(C("start_ms") / HOUR).alias("window_id")).distinct().select("title_id", "window_id", (C("window_id") * HOUR).alias("start_ms"), ((C("window_id") + 1) * HOUR).alias("end_ms"))
    events = m.where("source <> 'metadata'").select("title_id", C("start_ms").alias("r_start"), C("end_ms").alias("r_end"), F.when(C("source") == "video", C("cut")).alias("c"))
    return intervals.overlap_join(windows, events, HOUR).groupBy("title_id", "window_id").agg(F.count("*").alias("events"), F.coalesce(F.max("c"), F.lit(0.0)).alias("peak"))


_SPOKEN = """sp_r AS (SELECT *, max(end_ms) OVER (PARTITION BY title_id ORDER BY start_ms, end_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM media WHERE source = 'subtitle'),
sp_i AS (SELECT *, sum(CASE WHEN start_ms <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY title_id ORDER BY start_ms, end_ms, seq) AS island FROM sp_r),
sp AS (SELECT title_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM sp_i GROUP BY title_id, island),
gp0 AS (SELECT title_id, lag(end_ms) OVER (PARTITION BY title_id ORDER BY start_ms) AS s, start_ms AS e FROM sp), gp AS (SELECT title_id, s, e - s AS gap FROM gp0 WHERE s IS NOT NULL),
md AS (SELECT title_id, median(gap) AS med FROM gp GROUP BY title_id)"""
_GAP = 4 * HOUR
_SIGNALS = f"""{MEDIA}, {_SPOKEN}, sg AS (
SELECT title_id, 'visual-cut' AS kind, start_ms AS at_ms, least(1.0, cut) AS strength FROM media WHERE source = 'video' AND kind = 'scene-change' AND cut > 0 UNION ALL
SELECT title_id, 'location-change', start_ms, 0.8 FROM media WHERE source = 'video' AND kind = 'setting' UNION ALL SELECT title_id, 'user-seek', start_ms, 1.0 FROM media WHERE source = 'playback' AND kind = 'seek' UNION ALL
SELECT title_id, 'chapter-change', start_ms, 1.0 FROM media WHERE source = 'metadata' AND kind = 'chapter' UNION ALL SELECT title_id, 'on-screen-text', start_ms, 0.6 FROM media WHERE source = 'ocr' UNION ALL
SELECT gp.title_id, 'dialogue-gap', s + gap // 2, CASE WHEN med <= 0 THEN least(1.0, gap / 30000.0) ELSE greatest(0.0, least(1.0, (gap / med - 2) / 6)) END FROM gp JOIN md USING (title_id) WHERE gap >= {_GAP})"""


@query(f"WITH {_SIGNALS} SELECT title_id, kind, at_ms, strength FROM sg")
def w6_w7_boundary_signals(spark, sf_dir):
    return boundaries.signals(media(spark, sf_dir), _GAP)


_CLUSTER = 600_000
_CLUSTERS = f"""{_SIGNALS}, so AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY at_ms, kind, strength) AS n FROM sg),
cl AS (SELECT title_id, n, kind, at_ms, strength, at_ms AS anchor FROM so WHERE n = 1 UNION ALL
SELECT so.title_id, so.n, so.kind, so.at_ms, so.strength, CASE WHEN so.at_ms - cl.anchor <= {_CLUSTER} THEN cl.anchor ELSE so.at_ms END FROM cl JOIN so ON so.title_id = cl.title_id AND so.n = cl.n + 1)"""
_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in boundaries.WEIGHTS.items()) + " END"
_SCORES = f"""{_CLUSTERS}, ck AS (SELECT title_id, anchor, kind, max({_CASE} * strength) AS v, min(at_ms) AS first FROM cl GROUP BY title_id, anchor, kind),
cr AS (SELECT *, row_number() OVER (PARTITION BY title_id, anchor ORDER BY v DESC) AS i FROM ck),
sc AS (SELECT title_id, coalesce(min(CASE WHEN kind = 'visual-cut' THEN first END), min(CASE WHEN kind = 'chapter-change' THEN first END), min(CASE WHEN kind = 'user-seek' THEN first END), min(first)) AS at_ms, least(1.0, sum(v * pow(0.6, i - 1))) AS score, count(*) AS kinds FROM cr GROUP BY title_id, anchor)"""
_LEVEL_OF = "CASE WHEN score >= 0.75 THEN CASE WHEN kinds >= 2 THEN 'high' ELSE 'medium' END WHEN score >= 0.45 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'unknown' END"


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT title_id, anchor AS first_ms, count(*) AS n FROM cl GROUP BY title_id, anchor")
def w8_anchored_clusters(spark, sf_dir):
    s = boundaries.signals(media(spark, sf_dir), _GAP).withColumn("seq", F.monotonically_increasing_id())
    return boundaries.anchored_clusters(s.select("title_id", "at_ms", "seq"), _CLUSTER).groupBy("title_id", "cluster").agg(F.min("at_ms").alias("first_ms"), F.count("*").alias("n")).drop("cluster")


@query(f"WITH RECURSIVE {_SCORES} SELECT title_id, at_ms, round(score, 9) AS score, {_LEVEL_OF} AS confidence FROM sc")
def w9_candidate_scores(spark, sf_dir):
    return boundaries.score_candidates(boundaries.signals(media(spark, sf_dir), _GAP), _CLUSTER).withColumn("score", F.round("score", 9))


_LEAST = 12 * HOUR
_SELECT = f"""{_SCORES}, ca AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY at_ms) AS n FROM sc WHERE score >= 0.55),
se AS (SELECT title_id, n, at_ms AS kept, score AS best, 1 AS grp FROM ca WHERE n = 1 UNION ALL
SELECT ca.title_id, ca.n, CASE WHEN ca.at_ms - se.kept < {_LEAST} AND ca.score <= se.best THEN se.kept ELSE ca.at_ms END, CASE WHEN ca.at_ms - se.kept < {_LEAST} AND ca.score <= se.best THEN se.best ELSE ca.score END,
CASE WHEN ca.at_ms - se.kept < {_LEAST} THEN se.grp ELSE se.grp + 1 END FROM se JOIN ca ON ca.title_id = se.title_id AND ca.n = se.n + 1),
bd AS (SELECT title_id, arg_max(kept, n) AS at_ms, arg_max(best, n) AS score FROM se GROUP BY title_id, grp)"""


@query(f"WITH RECURSIVE {_SELECT} SELECT title_id, at_ms, round(score, 9) AS score FROM bd")
def w10_p1_detect_boundaries(spark, sf_dir):
    found = boundaries.detect_boundaries(media(spark, sf_dir), _CLUSTER, least_ms=_LEAST, least_gap=_GAP)
    return found.select("title_id", "at_ms", F.round("score", 9).alias("score"))


@query(f"""WITH RECURSIVE {_SELECT}, pl AS (SELECT m.title_id, m.start_ms, m.end_ms, count(b.at_ms) AS scene FROM media m LEFT JOIN bd b ON b.title_id = m.title_id AND b.at_ms <= m.start_ms GROUP BY m.title_id, m.seq, m.start_ms, m.end_ms),
s0 AS (SELECT title_id, scene, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS events FROM pl GROUP BY title_id, scene)
SELECT title_id, scene, start_ms, least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY title_id ORDER BY scene), end_ms)) AS end_ms, events FROM s0""")
def w11_split_scenes(spark, sf_dir):
    m = media(spark, sf_dir)
    b = boundaries.detect_boundaries(m, _CLUSTER, least_ms=_LEAST, least_gap=_GAP)
    return boundaries.scene_table(boundaries.split_scenes(m, b)).drop("scene_id")


@query(f"{WITH}, b AS (SELECT title_id, md5(source || ':' || CAST(start_ms // 60000 AS VARCHAR)) AS id, min(seq) AS seq, count(*) AS copies FROM ev GROUP BY 1, 2) SELECT * FROM b")
def w12_beat_dedupe(spark, sf_dir):
    e = evidence(spark, sf_dir).withColumn("id", F.md5(F.concat_ws(":", "source", F.floor(C("start_ms") / 60000))))
    return e.groupBy("title_id", "id").agg(F.min("seq").alias("seq"), F.count("*").alias("copies"))


_G = f"""WITH {EV}, g0 AS (SELECT title_id, lag(end_ms) OVER w AS s, start_ms AS e, end_ms FROM ev WHERE source = 'view' WINDOW w AS (PARTITION BY title_id ORDER BY start_ms, end_ms)),
g AS (SELECT title_id, s, e, e - s AS gap, row_number() OVER (PARTITION BY title_id ORDER BY e, end_ms) AS n FROM g0 WHERE s IS NOT NULL),
m AS (SELECT g.title_id, g.n, g.s, g.e, g.gap, median(h.gap) AS med FROM g LEFT JOIN g h ON h.title_id = g.title_id AND abs(h.n - g.n) BETWEEN 1 AND 6 AND h.gap > 0 GROUP BY g.title_id, g.n, g.s, g.e, g.gap)"""


@query(f"{_G} SELECT title_id, s AS start_ms, e AS end_ms, gap AS gap_ms, gap >= {4 * HOUR} OR gap >= 3 * coalesce(med, gap) AS significant FROM m WHERE gap >= {HOUR}")
def w15_find_silences(spark, sf_dir):
    return sequences.find_silences(evidence(spark, sf_dir).where("source = 'view'"), HOUR, 4 * HOUR)


@query(f"""{WITH} SELECT seq, CASE WHEN value / 100 > 0.5 AND k % 10 > 4 AND value > 18 THEN 'impact' WHEN k % 10 < 1 AND start_ms % 5000 > 700 AND start_ms % 5000 < 4000 AND value / 100 < 0.35 THEN 'alarm' WHEN k % 10 > 6 AND value / 100 < 0.3 AND value > 12 THEN 'applause' ELSE 'unclassified' END AS kind FROM ev""")
def w19_onset_classify(spark, sf_dir):
    return evidence(spark, sf_dir).select("seq", classify_onset(C("value"), C("value") / 100, C("start_ms") % 5000, (C("k") % 10) / 10).alias("kind"))


_FRAMES = """fr0 AS (SELECT CAST(label AS BIGINT) AS title_id, vec_id AS seq, vec_id * 500 AS at_ms, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings),
fr AS (SELECT title_id, seq, at_ms, i, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INT) AS luma FROM fr0),
od AS (SELECT title_id, seq, at_ms, lag(seq) OVER (PARTITION BY title_id ORDER BY at_ms, seq) AS prev FROM (SELECT DISTINCT title_id, seq, at_ms FROM fr)),
df AS (SELECT o.title_id, o.seq, o.at_ms, o.prev, a.i, a.luma, b.luma AS was, abs(a.luma - b.luma) AS d FROM od o JOIN fr a ON a.seq = o.seq JOIN fr b ON b.seq = o.prev AND b.i = a.i),
hs AS (SELECT seq, least(31, luma // 8) AS bin, count(*) / 64.0 AS share FROM fr GROUP BY 1, 2), hd AS (SELECT o.seq, 1 - coalesce(sum(least(a.share, coalesce(b.share, 0))), 0) AS hist FROM od o LEFT JOIN hs a ON a.seq = o.seq LEFT JOIN hs b ON b.seq = o.prev AND b.bin = a.bin WHERE o.prev IS NOT NULL GROUP BY o.seq),
mn AS (SELECT seq, sum(luma) / (64 * 255.0) AS mean FROM fr GROUP BY seq), fd AS (SELECT title_id, seq, at_ms, prev, sum(d) / (64 * 255.0) AS frame_difference FROM df GROUP BY 1, 2, 3, 4),
bl AS (SELECT seq, ((i - 1) // 8) // 4 * 2 + ((i - 1) % 8) // 4 AS b, sum(d) / (16 * 255.0) AS m FROM df GROUP BY 1, 2), bm AS (SELECT seq, avg(m) AS mean, max(m) AS top FROM bl GROUP BY seq),
rg AS (SELECT seq, greatest(sum(d) FILTER (WHERE (i - 1) // 8 < 4) / (32 * 255.0), sum(d) FILTER (WHERE (i - 1) // 8 >= 5) / (24 * 255.0)) AS text_change, sum(d) FILTER (WHERE (i - 1) // 8 BETWEEN 1 AND 5 AND (i - 1) % 8 BETWEEN 1 AND 6) / (30 * 255.0) AS face_change FROM df GROUP BY seq),
mt AS (SELECT fd.title_id, fd.seq, fd.at_ms, frame_difference, CASE WHEN bm.mean <= 0.001 THEN 0.0 ELSE least(1.0, bm.mean * 4 * (0.4 + 0.6 * least(1.0, (top - bm.mean) / greatest(bm.mean, 0.02)))) END AS motion,
least(1.0, greatest(sqrt(frame_difference * greatest(hist, 0)) * 2.2, CASE WHEN abs(a.mean - p.mean) > 0.35 THEN abs(a.mean - p.mean) ELSE 0.0 END)) AS cut , text_change, face_change, a.mean AS luminance FROM fd JOIN hd USING (seq) JOIN bm USING (seq) JOIN rg USING (seq) JOIN mn a ON a.seq = fd.seq JOIN mn p ON p.seq = fd.prev)"""


@query(f"WITH {_FRAMES} SELECT title_id, seq, round(frame_difference, 9) AS frame_difference, round(motion, 9) AS motion, round(cut, 9) AS cut, round(text_change, 9) AS text_change, round(face_change, 9) AS face_change, round(luminance, 9) AS luminance FROM mt")
def w22_frame_metrics(spark, sf_dir):
    m = sequences.frame_metrics(frames(spark, sf_dir), 8, 8)
    return m.select("title_id", "seq", *[F.round(c, 9).alias(c) for c in ("frame_difference", "motion", "cut", "text_change", "face_change", "luminance")])


@query(f"""WITH {_FRAMES}, nr AS (SELECT *, last_value(CASE WHEN cut >= 0.6 THEN at_ms END IGNORE NULLS) OVER (PARTITION BY title_id ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING) AS cut_at FROM mt WHERE NOT (frame_difference < 0.006 AND motion < 0.02 AND cut < 0.05)),
im AS (SELECT *, (least(1.0, 1.6 * (0.15 * frame_difference + 0.25 * motion + 0.35 * cut + 0.15 * text_change + 0.1 * face_change)) + CASE WHEN at_ms - cut_at <= 1500 THEN 0.2 * (1 - (at_ms - cut_at) / 1500) ELSE 0.0 END) * CASE WHEN luminance < 0.02 AND cut < 0.5 THEN 0.3 ELSE 1.0 END AS score FROM nr)
SELECT title_id, seq, at_ms, round(greatest(0.0, least(1.0, score)), 9) AS importance FROM im WHERE score >= 0.08""")
def w23_w25_scan(spark, sf_dir):
    return sequences.scan(frames(spark, sf_dir), 8, 8).select("title_id", "seq", "at_ms", F.round("importance", 9).alias("importance"))


# dark stretches, and jumps before which nothing is known
_SCANNED = _FRAMES.replace("CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INT) AS luma", "CASE WHEN seq // 100 % 4 = 3 THEN 0 ELSE CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INT) END AS luma").replace(
    "lag(seq) OVER (PARTITION BY title_id ORDER BY at_ms, seq) AS prev", "CASE WHEN seq % 50 <> 17 THEN lag(seq) OVER (PARTITION BY title_id ORDER BY at_ms, seq) END AS prev"
)
_LINE = "OVER (PARTITION BY title_id ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH {_SCANNED}, bk AS (SELECT seq, avg(luma) / 255 < 0.02 AND stddev_pop(luma) / 255 < 0.01 AS blank FROM fr GROUP BY seq),
j AS (SELECT od.title_id, od.seq, od.at_ms, od.seq % 50 = 17 AS reset, mt.seq IS NOT NULL AS seen, mt.frame_difference, mt.motion, mt.cut, mt.text_change, mt.face_change, mt.luminance, bk.blank,
 coalesce(mt.frame_difference < 0.006 AND mt.motion < 0.02 AND mt.cut < 0.05, false) AS redundant FROM od LEFT JOIN mt ON mt.seq = od.seq JOIN bk ON bk.seq = od.seq),
g AS (SELECT *, sum(CASE WHEN reset OR seen AND NOT redundant THEN 1 ELSE 0 END) {_LINE} AS still, sum(CASE WHEN reset THEN 1 ELSE 0 END) {_LINE} AS part, sum(CASE WHEN blank THEN 0 ELSE 1 END) {_LINE} AS run FROM j),
l AS (SELECT *, sum(CASE WHEN redundant THEN 1 ELSE 0 END) OVER (PARTITION BY title_id, still ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING) AS streak, last_value(CASE WHEN cut >= 0.6 THEN at_ms END IGNORE NULLS) OVER (PARTITION BY title_id, part ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING) AS cut_at,
 sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY title_id, run ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING) AS dark FROM g),
im AS (SELECT *, (least(1.0, 1.6 * (0.15 * frame_difference + 0.25 * motion + 0.35 * cut + 0.15 * text_change + 0.1 * face_change)) + CASE WHEN at_ms - cut_at <= 1500 THEN 0.2 * (1 - (at_ms - cut_at) / 1500) ELSE 0.0 END) * CASE WHEN luminance < 0.02 AND cut < 0.5 THEN 0.3 ELSE 1.0 END AS score FROM l)
SELECT title_id, count(*) AS observations, count(*) FILTER (WHERE seen AND NOT redundant AND score >= 0.08) AS events, count(*) FILTER (WHERE redundant) AS redundant, count(*) FILTER (WHERE cut >= 0.6) AS cuts, count(*) FILTER (WHERE blank) AS blanks,
 CAST(max(streak) AS BIGINT) AS longest_streak, min(CASE WHEN blank AND dark = 5 THEN at_ms END) AS blank_at, (count(*) - 1) / ((max(at_ms) - min(at_ms)) / 1000) AS fps FROM im GROUP BY title_id""")
def w25_scan_report(spark, sf_dir):
    """The scan of frames with dark stretches and jumps: counts, streaks of still frames and where a dark run is full."""
    f = frames(spark, sf_dir)
    dark = F.transform("luma", lambda v: F.when(F.floor(C("seq") / 100) % 4 == 3, 0).otherwise(v))
    return scanner.scan_report(scanner.scan_frames(f.withColumns({"luma": dark, "reset": C("seq") % 50 == 17}), 8, 8, blanks=5))


@query("""WITH v AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings), o AS (SELECT vec_id, label, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
d AS (SELECT o.vec_id, 1 - sum(CAST(a.x AS DOUBLE) * b.x) / (sqrt(sum(CAST(a.x AS DOUBLE) * a.x)) * sqrt(sum(CAST(b.x AS DOUBLE) * b.x))) AS d, o.label FROM o JOIN v a ON a.vec_id = o.vec_id JOIN v b ON b.vec_id = o.prev AND b.i = a.i GROUP BY o.vec_id, o.label)
SELECT label, round(avg(d), 6) AS mean_distance, count(*) >= 3 AND avg(d) > 0.55 AS overlapped FROM d GROUP BY label""")
def w21_p17_overlapped_speech(spark, sf_dir):
    from ..operators.features import looks_overlapped

    e = table(spark, sf_dir, "embeddings").select(C("label").alias("title_id"), C("vec_id").alias("seq"), "embedding")
    return looks_overlapped(e).select(C("title_id").alias("label"), F.round("mean_distance", 6).alias("mean_distance"), "overlapped")


_MOVES = "mv AS (SELECT title_id, seq, start_ms AS at_ms, value > 10 AS moves FROM ev)"


@query(f"""WITH {EV}, {_MOVES}, x AS (SELECT *, lag(moves) OVER w AS was, sum(CASE WHEN moves THEN 1 ELSE 0 END) OVER w AS run FROM mv WINDOW w AS (PARTITION BY title_id ORDER BY at_ms, seq)),
s AS (SELECT title_id, run, min(at_ms) AS start_ms FROM x WHERE NOT moves AND run > 0 GROUP BY title_id, run), e AS (SELECT title_id, run, min(at_ms) AS end_ms FROM x WHERE moves GROUP BY title_id, run)
SELECT s.title_id, start_ms, end_ms FROM s JOIN e ON e.title_id = s.title_id AND e.run = s.run + 1 WHERE end_ms - start_ms >= {HOUR}""")
def w28_hesitations(spark, sf_dir):
    e = evidence(spark, sf_dir).select("title_id", "seq", C("start_ms").alias("at_ms"), C("value").alias("motion"))
    return sequences.hesitations(e, 10, HOUR)


@query(f"""WITH {EV}, b AS (SELECT title_id, min(start_ms) AS low, max(end_ms) AS high FROM ev GROUP BY title_id), w AS (SELECT ev.*, least(49, floor(((start_ms + end_ms) / 2.0 - low) * 50 / greatest(1, high - low))) AS part FROM ev JOIN b USING (title_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY title_id, part ORDER BY value DESC, start_ms, seq) = 1 AS first FROM w)
SELECT title_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY CASE WHEN first THEN 0 ELSE 1 END, value DESC, start_ms, seq) AS n FROM f) WHERE n <= 50""")
def w31_select_windows(spark, sf_dir):
    return sequences.select_windows(evidence(spark, sf_dir).withColumn("importance", C("value")), 50).select("title_id", "seq")


@query(f"""{WITH}, d AS (SELECT title_id, max(end_ms) // 1000 AS ms FROM ev GROUP BY title_id)
SELECT title_id, CASE WHEN ms > 900000 THEN 12 ELSE greatest(12, least(60, CAST(ceil(ms * 0.5 / 4000) AS INT))) END AS requests, least(240, greatest(36, CAST(ceil(ms / CASE WHEN ms <= 900000 THEN 3000.0 ELSE 15000.0 END) AS INT))) AS captures FROM d""")
def w32_budgets(spark, sf_dir):
    from ..operators.features import capture_budget, request_budget

    d = evidence(spark, sf_dir).groupBy("title_id").agg(F.floor(F.max("end_ms") / 1000).alias("ms"))
    return d.select("title_id", request_budget(F.lit(12), C("ms"), 4000, 0.5, short_ms=900_000, most=60).alias("requests"), capture_budget(F.lit(12), C("ms"), short_ms=900_000, most=240).alias("captures"))


@query(f"""{WITH}, o AS (SELECT title_id, seq, row_number() OVER (PARTITION BY title_id ORDER BY start_ms, seq) - 1 AS i, count(*) OVER (PARTITION BY title_id) AS n FROM ev), j AS (SELECT unnest(range(0, 20)) AS j)
SELECT DISTINCT title_id, seq FROM o, j WHERE i = CAST(floor(j * (n - 1) / 19.0 + 0.5) AS BIGINT) OR n <= 20""")
def w33_even_sample(spark, sf_dir):
    return sequences.even_sample(evidence(spark, sf_dir).select("title_id", "seq", C("start_ms").alias("at_ms")), 20).select("title_id", "seq")


@query(f"""{WITH}, d AS (SELECT title_id, max(end_ms) AS ms FROM ev GROUP BY title_id), s AS (SELECT *, greatest(2000, ceil(ms / 240.0 / 500) * 500) AS step FROM d), t AS (SELECT title_id, ms, step, least(step / 2, ms / 2.0) AS b, unnest(range(0, 241)) AS i FROM s)
SELECT title_id, i // 30 AS sheet, CAST(floor(b + i * step + 0.5) AS BIGINT) AS at_ms FROM t WHERE b + i * step < ms AND i // 30 < 8""")
def w34_overview_plan(spark, sf_dir):
    return sequences.overview_plan(evidence(spark, sf_dir).groupBy("title_id").agg(F.max("end_ms").alias("duration_ms")))


@query(f"""{WITH} SELECT title_id, seq, start_ms + least(greatest(k * 10000, 0), end_ms - start_ms) AS at_ms, CASE rank WHEN 3 THEN 1.0 WHEN 2 THEN 0.8 WHEN 1 THEN 0.55 ELSE 0.5 END AS weight FROM ev WHERE source = 'click'""")
def w36_salient_moments(spark, sf_dir):
    from ..operators.features import salient_moments

    e = evidence(spark, sf_dir).where("source = 'click'").select("title_id", "seq", "start_ms", "end_ms", F.array(F.struct((C("k") * 10000).alias("offset_ms"), F.lit("moves").alias("description"), "confidence")).alias("actions"))
    return salient_moments(e).select("title_id", "seq", "at_ms", "weight")


@query(f"{WITH}, s AS (SELECT title_id, seq, end_ms AS m, lag(end_ms) OVER (PARTITION BY title_id ORDER BY start_ms, seq) AS p FROM ev) SELECT title_id, seq, p AS from_ms, m AS to_ms FROM s WHERE abs(m - p) > {HOUR}")
def w39_seeks(spark, sf_dir):
    return sequences.seeks(evidence(spark, sf_dir).select("title_id", "seq", C("start_ms").alias("at_ms"), C("end_ms").alias("media_ms")), HOUR)


@query(f"""{WITH}, r AS (SELECT title_id, seq, start_ms, max(start_ms) OVER (PARTITION BY title_id) AS last, row_number() OVER w AS n, sum(k) OVER (PARTITION BY title_id ORDER BY start_ms DESC, seq DESC ROWS UNBOUNDED PRECEDING) AS b FROM ev WINDOW w AS (PARTITION BY title_id ORDER BY start_ms DESC, seq DESC))
SELECT title_id, seq FROM r WHERE start_ms >= last - {500 * HOUR} AND n <= 300 AND b <= 12000""")
def w41_recency_buffer(spark, sf_dir):
    return sequences.recent(evidence(spark, sf_dir).select("title_id", "seq", C("start_ms").alias("at_ms"), C("k").alias("size")), 500 * HOUR, 300, 12000).select("title_id", "seq")


@query(f"{WITH}, c AS (SELECT title_id, seq, source, lag(source) OVER (PARTITION BY title_id ORDER BY start_ms, seq) AS p FROM ev) SELECT title_id, seq, source FROM c WHERE p IS NULL OR p <> source")
def s13_change_feed(spark, sf_dir):
    return sequences.changes(evidence(spark, sf_dir).select("title_id", "seq", C("start_ms").alias("at_ms"), "source"), "source").select("title_id", "seq", "source")


@query(f"WITH {MEDIA} SELECT seq, CASE WHEN cut >= 0.6 THEN 'shot' END AS shot, CASE WHEN cut >= 0.35 THEN 'strong' WHEN cut >= 0.12 THEN 'some' END AS movement FROM media WHERE source = 'video' AND cut >= 0.12")
def p11_local_vision_rules(spark, sf_dir):
    m = media(spark, sf_dir).where("source = 'video' and cut >= 0.12")
    return m.select("seq", F.when(C("cut") >= 0.6, "shot").alias("shot"), F.when(C("cut") >= 0.35, "strong").when(C("cut") >= 0.12, "some").alias("movement"))




@query("""WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings), l AS (SELECT vec_id, i, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INT) AS y FROM v),
d AS (SELECT a.vec_id, abs(a.y - b.y) AS d FROM l a JOIN l b ON b.vec_id = a.vec_id AND b.i = a.i + 1 WHERE a.i // 8 < 4 AND a.i % 8 < 7) SELECT vec_id AS seq, least(1.0, sum(d) / (28 * 96.0)) AS energy FROM d GROUP BY vec_id""")
def p18_edge_energy(spark, sf_dir):
    return frames(spark, sf_dir).select("seq", sequences.edge_energy(C("luma"), 8, 8, 0.05, 0.05, 0.9, 0.35).alias("energy"))
