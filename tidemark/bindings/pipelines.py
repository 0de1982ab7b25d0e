"""Composed plans over the tables: fusion, search, requests, characters, builds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans import build, characters, fusion, project, requests, search
from ..registry import query
from .documents import _BEATS, beats
from .joins import _PAIRS, BUCKET, _moments, cues
from .sequences import _SELECT
from .views import EV, LEVEL, MEDIA, WITH, evidence, media, table

C = F.col
HOUR = 3_600_000


@query(f"""WITH {_PAIRS}, h AS (SELECT mt.seq, min(a.start_ms) AS onset, string_agg(CAST(asr_seq AS VARCHAR), ',' ORDER BY asr_seq) AS ids FROM mt JOIN a ON a.seq = mt.asr_seq GROUP BY mt.seq),
b AS (SELECT title_id, CASE WHEN onset > start_ms AND onset - start_ms < {HOUR} THEN onset ELSE start_ms END AS start_ms, end_ms, text, CASE WHEN onset IS NULL THEN 'subtitle' ELSE 'subtitle,audio-asr' END AS sources, least(3, rank + CASE WHEN onset IS NULL THEN 0 ELSE 1 END) AS level, CAST(c.seq AS VARCHAR) || coalesce(',' || ids, '') AS ids FROM c LEFT JOIN h ON h.seq = c.seq
 UNION ALL SELECT title_id, start_ms, end_ms, text, 'audio-asr', rank, CAST(seq AS VARCHAR) FROM a WHERE seq NOT IN (SELECT asr_seq FROM mt) AND seq NOT IN (SELECT asr_seq FROM cf))
SELECT title_id, md5('dialogue:' || title_id || ':' || start_ms || ':' || ids) AS beat_id, start_ms, end_ms, text, 'en=' || text AS variants, sources, {LEVEL.format('level')} AS confidence, ids AS evidence_ids FROM b""")
def p2_fuse_dialogue(spark, sf_dir):
    beats = fusion.fuse_dialogue(*cues(spark, sf_dir), BUCKET, HOUR)[0]
    variants = F.array_join(F.transform(F.array_sort(F.map_entries("variants")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("variants")
    return beats.select("title_id", "beat_id", "start_ms", "end_ms", "text", variants, F.array_join("sources", ",").alias("sources"), "confidence", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query(f"""{WITH}, t AS (SELECT *, CASE WHEN k % 4 = 0 THEN '[noise]' ELSE 'words' END AS text FROM ev), c AS (SELECT title_id, start_ms FROM t WHERE source = 'view' AND text = '[noise]')
SELECT title_id, seq, 'sound' AS type, start_ms FROM t WHERE source = 'view' AND text = '[noise]' UNION ALL
SELECT title_id, seq, 'sound', start_ms FROM t WHERE source = 'error' AND NOT (rank = 0) AND NOT EXISTS (SELECT 1 FROM c WHERE c.title_id = t.title_id AND abs(c.start_ms - t.start_ms) < {HOUR}) UNION ALL
SELECT title_id, seq, 'action', start_ms FROM t WHERE source = 'click' UNION ALL SELECT title_id, seq, 'on-screen-text', start_ms FROM t WHERE source = 'signup'""")
def p3_fuse_other(spark, sf_dir):
    e = evidence(spark, sf_dir)
    s = C("source")
    source = F.when(s == "view", "subtitle").when(s == "error", "audio-event").when(s == "click", "video").when(s == "signup", "ocr").otherwise("metadata")
    rows = e.select("title_id", "seq", source.alias("source"), F.when(s == "error", "unclassified").otherwise("action").alias("kind"), "start_ms", F.when(C("k") % 4 == 0, "[noise]").otherwise("words").alias("text"), F.lit(False).alias("significant"), "confidence")
    return fusion.fuse_other(rows, HOUR).select("title_id", "seq", "type", "start_ms")


def _built(spark, sf_dir):
    m = media(spark, sf_dir).withColumn("key", F.when(C("source") == "subtitle", F.concat_ws(":", "source", "user_id")))
    return build.build(m, 2 * HOUR, 600_000, 12 * HOUR, 4 * HOUR)


# the build's evidence: captions of one user within two hours of the last kept one only extend it
_CLEAN = f"""{MEDIA.replace(", media AS", ", media0 AS")}, kd AS (SELECT *, CASE WHEN source = 'subtitle' THEN user_id END AS key FROM media0),
ko AS (SELECT *, row_number() OVER (PARTITION BY title_id, key ORDER BY start_ms, seq) AS n FROM kd WHERE key IS NOT NULL),
kr AS (SELECT title_id, key, n, start_ms AS anchor, seq AS kept, end_ms FROM ko WHERE n = 1 UNION ALL SELECT ko.title_id, ko.key, ko.n, CASE WHEN ko.start_ms - kr.anchor <= {2 * HOUR} THEN kr.anchor ELSE ko.start_ms END,
 CASE WHEN ko.start_ms - kr.anchor <= {2 * HOUR} THEN kr.kept ELSE ko.seq END, ko.end_ms FROM kr JOIN ko ON ko.title_id = kr.title_id AND ko.key = kr.key AND ko.n = kr.n + 1),
kk AS (SELECT kept, max(end_ms) AS till FROM kr GROUP BY kept), media AS (SELECT kd.* REPLACE (coalesce(kk.till, kd.end_ms) AS end_ms) FROM kd LEFT JOIN kk ON kk.kept = kd.seq WHERE kd.key IS NULL OR kk.kept IS NOT NULL)"""
_SCENES = f"""WITH RECURSIVE {_SELECT.replace(MEDIA, _CLEAN)}, pl AS (SELECT m.title_id, m.seq, m.source, m.start_ms, m.end_ms, count(b.at_ms) AS scene FROM media m LEFT JOIN bd b ON b.title_id = m.title_id AND b.at_ms <= m.start_ms GROUP BY ALL),
s0 AS (SELECT title_id, scene, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS events FROM pl GROUP BY title_id, scene),
scenes AS (SELECT title_id, scene, md5('scene:' || title_id || ':' || start_ms) AS scene_id, start_ms, least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY title_id ORDER BY scene), end_ms)) AS end_ms, events FROM s0)"""


@query(f"{_SCENES} SELECT * FROM scenes")
def p4_p5_build(spark, sf_dir):
    return _built(spark, sf_dir)[0]


@query(f"""{_SCENES}, ob AS (SELECT title_id, start_ms, greatest(end_ms, start_ms + 100) AS end_ms FROM media), o1 AS (SELECT *, max(end_ms) OVER (PARTITION BY title_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ob),
o2 AS (SELECT *, sum(CASE WHEN start_ms <= reach + 250 THEN 0 ELSE 1 END) OVER (PARTITION BY title_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM o1), o3 AS (SELECT title_id, max(end_ms) - min(start_ms) AS ms FROM o2 GROUP BY title_id, island),
c AS (SELECT title_id, sum(ms) AS covered FROM o3 GROUP BY title_id), d AS (SELECT title_id, max(end_ms) AS duration, count(*) AS events, count(DISTINCT source) AS sources FROM media GROUP BY title_id), n AS (SELECT title_id, count(*) AS scenes FROM scenes GROUP BY title_id)
SELECT title_id, scenes, events, sources, least(1.0, CAST(covered AS DOUBLE) / duration) AS ratio FROM n JOIN d USING (title_id) JOIN c USING (title_id)""")
def p8_inspect(spark, sf_dir):
    return build.inspect(*_built(spark, sf_dir))


_SPEAKER = "CASE k % 3 WHEN 0 THEN 'ANNA: ' WHEN 1 THEN 'BEN: ' ELSE '' END"


def _project(spark, sf_dir):
    """The media view with captions that a label precedes or not, actions, settings and on-screen text."""
    m = media(spark, sf_dir)
    label = F.when(C("k") % 3 == 0, "ANNA: ").when(C("k") % 3 == 1, "BEN: ").otherwise("")
    text = F.when(C("source") == "subtitle", F.concat(label, F.lit("line "), C("k").cast("string"))).when((C("source") == "video") & (C("kind") == "setting"), F.concat(F.lit("INT. ROOM "), C("k").cast("string"), F.lit(" - NIGHT")))
    text = text.when((C("source") == "video") & (C("kind") == "action"), "runs").when(C("source") == "ocr", "EXIT")
    rows = m.withColumns({"key": F.when(C("source") == "subtitle", F.concat_ws(":", "source", "user_id")), "text": text, "language": F.lit("en")})
    return project.build_project(rows, BUCKET, HOUR, HOUR, "en", 2 * HOUR, 600_000, 12 * HOUR, 4 * HOUR)


# labels within a scene, and alternation where just two speak in it; a title's memory runs over scenes
_BEATS_OF = f"""{_SCENES.replace("WITH RECURSIVE", "WITH RECURSIVE", 1)}, tx AS (SELECT title_id, seq, source, kind, k, rank, start_ms, end_ms FROM media),
ps AS (SELECT tx.*, pl.scene FROM tx JOIN pl ON pl.seq = tx.seq),
bt AS (SELECT title_id, scene, seq, start_ms, CASE WHEN source = 'subtitle' THEN 'dialogue' WHEN source = 'ocr' THEN 'on-screen-text' ELSE 'action' END AS type,
 CASE WHEN source = 'subtitle' THEN CASE k % 3 WHEN 0 THEN 'ANNA' WHEN 1 THEN 'BEN' END END AS who FROM ps WHERE source = 'subtitle' OR source = 'ocr' OR (source = 'video' AND kind = 'action')),
pr AS (SELECT title_id, scene, list_sort(list(DISTINCT who)) AS present FROM bt WHERE who IS NOT NULL GROUP BY title_id, scene),
dn AS (SELECT bt.*, present, row_number() OVER (PARTITION BY bt.title_id ORDER BY start_ms, seq) AS n FROM bt LEFT JOIN pr ON pr.title_id = bt.title_id AND pr.scene = bt.scene WHERE type = 'dialogue'),
al AS (SELECT DISTINCT title_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS how, CAST(NULL AS VARCHAR) AS last FROM dn
 UNION ALL SELECT d.title_id, d.n, d.seq, coalesce(d.who, x.other), CASE WHEN d.who IS NOT NULL THEN 'label' WHEN x.other IS NOT NULL THEN 'alternation' ELSE 'unknown' END, coalesce(d.who, x.other, al.last)
 FROM al JOIN dn d ON d.title_id = al.title_id AND d.n = al.n + 1, LATERAL (SELECT CASE WHEN d.who IS NULL AND len(d.present) = 2 AND list_contains(d.present, al.last) THEN list_filter(d.present, lambda p: p <> al.last)[1] END AS other) x),
ob AS (SELECT bt.title_id, bt.scene, bt.seq, bt.type, bt.start_ms, al.name, al.how, row_number() OVER (PARTITION BY bt.title_id ORDER BY bt.start_ms, CASE bt.type WHEN 'on-screen-text' THEN 1 WHEN 'action' THEN 3 ELSE 4 END, bt.seq) AS place FROM bt LEFT JOIN al ON al.title_id = bt.title_id AND al.seq = bt.seq)"""


@query(f"{_BEATS_OF} SELECT title_id, scene, place, seq, type, start_ms, name, how AS attribution FROM ob")
def p5_project_beats(spark, sf_dir):
    return _project(spark, sf_dir).beats.select("title_id", "scene", "place", "seq", "type", "start_ms", "name", "attribution")


@query(f"""{_BEATS_OF}, st AS (SELECT title_id, scene, arg_max('INT. ROOM ' || k || ' - NIGHT', rank * 1000000000000000 - start_ms * 1000 - seq % 1000) AS setting FROM ps WHERE source = 'video' AND kind = 'setting' GROUP BY title_id, scene),
pv AS (SELECT title_id, scene, {LEVEL.format('least(3, max(rank) + CASE WHEN count(DISTINCT source) >= 2 THEN 1 ELSE 0 END)')} AS confidence FROM ps GROUP BY title_id, scene),
bs AS (SELECT title_id, scene, count(*) AS beats, count(DISTINCT name) AS characters FROM ob GROUP BY title_id, scene)
SELECT s.title_id, s.scene, s.scene_id, s.start_ms, s.end_ms, s.events, st.setting, pv.confidence, coalesce(bs.beats, 0) AS beats, coalesce(bs.characters, 0) AS characters FROM scenes s LEFT JOIN st ON st.title_id = s.title_id AND st.scene = s.scene LEFT JOIN pv ON pv.title_id = s.title_id AND pv.scene = s.scene LEFT JOIN bs ON bs.title_id = s.title_id AND bs.scene = s.scene""")
def p4_project_scenes(spark, sf_dir):
    return _project(spark, sf_dir).scenes.select("title_id", "scene", "scene_id", "start_ms", "end_ms", "events", "setting", "confidence", "beats", "characters")


@query(f"{_BEATS_OF} SELECT title_id, scene, name, count(*) AS lines, min(start_ms) AS first_ms, max(start_ms) AS last_ms FROM ob WHERE name IS NOT NULL GROUP BY title_id, scene, name")
def p5_project_presence(spark, sf_dir):
    p = _project(spark, sf_dir)
    names = p.characters.select("title_id", "character_id", C("cue").alias("name"))
    return p.presence.join(names.hint("merge"), ["title_id", "character_id"]).drop("character_id")


@query(f"""{_SCENES}, p AS (SELECT title_id, max(start_ms) AS now_ms FROM scenes GROUP BY title_id),
f AS (SELECT scenes.*, sum(CASE WHEN end_ms < now_ms - {HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY title_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS opened FROM scenes JOIN p USING (title_id))
SELECT title_id, scene, scene_id, start_ms, end_ms, events, CASE WHEN opened = 0 THEN 'finalized' ELSE 'provisional' END AS status FROM f""")
def r2_finalized_scenes(spark, sf_dir):
    scenes, _, _ = _built(spark, sf_dir)
    return build.finalize(scenes, scenes.groupBy("title_id").agg(F.max("start_ms").alias("now_ms")), HOUR)


@query(f"WITH {_BEATS} SELECT title_id, place, type, CAST(strpos(lower(text), 'th') - 1 AS INT) AS at FROM b WHERE contains(regexp_replace(lower(text), '[.,!?;:\"()]', '', 'g'), 'th') AND type = 'dialogue'")
def p7_search(spark, sf_dir):
    return search.search(beats(spark, sf_dir), "Th", "dialogue", None).select("title_id", "place", "type", "at")


def _scoped(spark, sf_dir):
    """The beats with dialogue in two variants: one with dashes for the word "the", then the text itself."""
    b = beats(spark, sf_dir)
    dashed = F.regexp_replace("text", r"\bthe\b", "\u2014")
    two = F.array(F.struct(F.lit("aa").alias("language"), dashed.alias("text")), F.struct(F.lit("bb").alias("language"), C("text").alias("text")))
    return b.withColumn("variants", F.when(C("type") == "dialogue", two))


def _found(needle: str, text: str) -> str:
    """Place and length of the first hit, by an array of characters with their places."""
    signs = "[.,!?;:''\"()\\[\\]{{}}\\-\u2013\u2014\u2026\u00b7\u2018\u2019\u02bc\u201c\u201d]"
    return f"""seen AS (SELECT *, list_filter(list_transform(range(1, length({text}) + 1), lambda i: {{{{'c': lower(substr({text}, i, 1)), 'i': i - 1}}}}), lambda x: NOT regexp_matches(x.c, '{signs}')) AS a FROM cand),
single AS (SELECT * EXCLUDE (a), list_filter(a, lambda x, k: x.c <> ' ' OR (k > 1 AND a[k - 1].c <> ' ')) AS a FROM seen), cut AS (SELECT * EXCLUDE (a), CASE WHEN a[len(a)].c = ' ' THEN a[:len(a) - 1] ELSE a END AS a FROM single),
hit AS (SELECT *, strpos(array_to_string(list_transform(a, lambda x: x.c), ''), '{needle}') AS p FROM cut)""".replace("{{", "{").replace("}}", "}")


_VARIANTS = "v AS (SELECT title_id, place, type, role, 1 AS n, 'aa' AS language, regexp_replace(text, '\\bthe\\b', '\u2014', 'g') AS text FROM b WHERE type = 'dialogue' UNION ALL SELECT title_id, place, type, role, 2, 'bb', text FROM b WHERE type = 'dialogue' UNION ALL SELECT title_id, place, type, NULL, 3, NULL, text FROM b WHERE type <> 'dialogue')"
_NEEDLE = "in the"


@query(f"""WITH {_BEATS}, {_VARIANTS},
cand AS (SELECT 'all' AS scope, * FROM v UNION ALL SELECT 'language', * FROM v WHERE n = 2 UNION ALL SELECT 'first', * FROM v WHERE n = 1 UNION ALL SELECT 'action', * FROM v WHERE n = 3), {_found(_NEEDLE, "text")},
best AS (SELECT *, row_number() OVER (PARTITION BY scope, title_id, place ORDER BY n) AS k FROM hit WHERE p > 0)
SELECT scope, title_id, place, language, text, CAST(a[p].i AS INT) AS at, CAST(greatest(1, coalesce(a[p + {len(_NEEDLE)}].i, length(text)) - a[p].i) AS INT) AS length FROM best WHERE k = 1
UNION ALL SELECT 'speaker', title_id, place, language, text, 0, 0 FROM v WHERE n = 2 AND contains(role, 'ser')""")
def p7_search_scopes(spark, sf_dir):
    b = _scoped(spark, sf_dir)
    asked = {
        "all": search.search(b, "In, the", limit=None, all_languages=True), "language": search.search(b, "IN THE", "dialogue", None, "bb"), "first": search.search(b, "in the", "dialogue", None),
        "action": search.search(b, "in the", "action", None), "speaker": search.search(b, "SER", "speaker", None, "bb"),
    }
    out = None
    for scope, hits in asked.items():
        hits = hits.select(F.lit(scope).alias("scope"), "title_id", "place", "language", "text", "at", "length")
        out = hits if out is None else out.unionAll(hits)
    return out


@query(f"""WITH {_BEATS}, {_VARIANTS}, cand AS (SELECT * FROM v WHERE n <> 2), {_found(_NEEDLE, "text")}
SELECT title_id, place, CAST(a[p].i AS INT) AS at FROM hit WHERE p > 0 ORDER BY title_id, place LIMIT 50""")
def k5_search_limit(spark, sf_dir):
    """The first 50 hits by title and place: the limit is the feature."""
    return search.search(_scoped(spark, sf_dir), "in the", limit=50).select("title_id", "place", "at")


@query(f"""{WITH}, w AS (SELECT * FROM ev WHERE source = 'view'), s AS (SELECT title_id, seq AS window_seq, start_ms AS a, end_ms AS b, 0 AS i, greatest(start_ms, least(end_ms, start_ms - 1000)) AS start_ms, greatest(start_ms, least(end_ms, start_ms + k * 60000)) AS end_ms FROM w WHERE k % 2 = 0 UNION ALL SELECT title_id, seq, start_ms, end_ms, 0, start_ms, end_ms FROM w WHERE k % 2 = 1)
, p AS (SELECT s.window_seq, v.seq AS speaker_seq, row_number() OVER (PARTITION BY s.window_seq ORDER BY least(s.end_ms, v.end_ms) - greatest(s.start_ms, v.start_ms) DESC, v.start_ms, v.seq) AS n FROM s JOIN ev v ON v.source = 'signup' AND v.title_id = s.title_id AND v.start_ms < s.end_ms AND s.start_ms < v.end_ms)
SELECT s.title_id, s.window_seq, s.i, s.start_ms, s.end_ms, p.speaker_seq FROM s LEFT JOIN p ON p.window_seq = s.window_seq AND p.n = 1""")
def p9_transcript_to_evidence(spark, sf_dir):
    e = evidence(spark, sf_dir)
    segment = F.array(F.struct(F.lit(-1000).cast("long").alias("start_ms"), (C("k") * 60000).alias("end_ms"), F.lit("said").alias("text")))
    w = e.where("source = 'view'").select("title_id", "seq", "start_ms", "end_ms", F.lit("all of it").alias("text"), F.when(C("k") % 2 == 0, segment).alias("segments"))
    speakers = e.where("source = 'signup'").select("title_id", C("seq").alias("r_seq"), C("start_ms").alias("r_start"), C("end_ms").alias("r_end"))
    return requests.transcript_to_evidence(w, speakers, HOUR).select("title_id", "window_seq", "i", "start_ms", "end_ms", "speaker_seq")


def _analyses(spark, sf_dir):
    """Windows of clicks with provider results in prose; some are broken."""
    e = evidence(spark, sf_dir).where("source = 'click'")
    body = F.concat(F.lit('{"actions": [{"offset_ms": '), C("k").cast("string"), F.lit(', "description": "runs", "confidence": "low"}, {"description": " "}], "text": [{"text": "EXIT", "offset_ms": 5}]}'))
    text = F.when(C("k") % 5 == 0, "no result").when(C("k") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return e.select("title_id", "seq", "start_ms", "end_ms", "k", text.alias("answer"))


@query(f"""{WITH}, w AS (SELECT * FROM ev WHERE source = 'click' AND k % 5 <> 0) SELECT title_id, seq AS window_seq, 'video' AS source, 'action' AS kind, start_ms + least(greatest(k, 0), end_ms - start_ms) AS at_ms, 'runs' AS text, 'low' AS confidence, true AS inferred FROM w
UNION ALL SELECT title_id, seq, 'ocr', 'text', start_ms + least(5, end_ms - start_ms), 'EXIT', 'low', true FROM w""")
def x31_x32_p10_vision_to_evidence(spark, sf_dir):
    w = _analyses(spark, sf_dir)
    return requests.vision_to_evidence(w.withColumn("v", requests.validate_analysis(requests.extract_json(C("answer")))))


@query(f"""WITH {EV}, m AS (SELECT title_id, start_ms, seq, CASE WHEN source = 'view' THEN 'name:user ' || CAST(user_id AS VARCHAR) ELSE 'speaker:' || CAST(user_id AS VARCHAR) END AS key FROM ev WHERE source IN ('view', 'click')),
o AS (SELECT title_id, key, min(start_ms * 1000000 + seq) AS f, count(*) AS lines FROM m GROUP BY title_id, key), n AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY f) AS c, sum(CASE WHEN starts_with(key, 'speaker:') THEN 1 ELSE 0 END) OVER (PARTITION BY title_id ORDER BY f // 1000000, key) AS s FROM o)
SELECT title_id, key, 'character-' || CAST(c AS VARCHAR) AS character_id, lines, CASE WHEN starts_with(key, 'name:') THEN upper(substr(key, 6)) ELSE 'SPEAKER ' || CAST(s AS VARCHAR) END AS cue FROM n""")
def p13_p14_characters(spark, sf_dir):
    e = evidence(spark, sf_dir).where("source in ('view', 'click')")
    m = e.select("title_id", C("start_ms").alias("at_ms"), "seq", F.when(C("source") == "view", F.concat(F.lit(" User  "), C("user_id").cast("string"))).alias("name"), C("user_id").cast("string").alias("speaker"))
    c = characters.cue_name(characters.ensure_characters(m))
    return c.select("title_id", "key", "character_id", "lines", F.trim(F.regexp_replace("cue", r"\s+", " ")).alias("cue"))


@query(f"""WITH {EV}, l AS (SELECT title_id, seq, start_ms AS at_ms, 'c' || CAST(user_id % 4 AS VARCHAR) AS character_id FROM ev WHERE source = 'view'), m AS (SELECT title_id, median(start_ms) AS mid, min(seq) AS one FROM ev WHERE source = 'view' GROUP BY title_id),
a AS (SELECT l.title_id, l.seq, l.at_ms, CASE WHEN character_id = 'c1' THEN 'c2' ELSE character_id END AS c FROM l), b AS (SELECT a.title_id, a.seq, CASE WHEN c = 'c2' AND at_ms >= floor(mid) THEN 'c9' ELSE c END AS c, one FROM a JOIN m USING (title_id))
SELECT title_id, seq, CASE WHEN seq = one THEN 'c7' ELSE c END AS character_id FROM b""")
def p12_corrections(spark, sf_dir):
    e = evidence(spark, sf_dir).where("source = 'view'")
    lines = e.select("title_id", "seq", C("start_ms").alias("at_ms"), F.concat(F.lit("c"), (C("user_id") % 4).cast("string")).alias("character_id"))
    m = e.groupBy("title_id").agg(F.floor(F.median("start_ms")).alias("mid"), F.min("seq").alias("one"))
    entry = lambda n, op, a, b, line, at: F.struct(F.lit(n).alias("log_seq"), F.lit(op).alias("op"), F.lit(a).cast("string").alias("from_id"), F.lit(b).alias("to_id"), line.cast("long").alias("line_seq"), at.cast("long").alias("at_ms"))
    none = F.lit(None)
    log = m.select("title_id", F.explode(F.array(entry(1, "merge", "c1", "c2", none, none), entry(2, "forward", "c2", "c9", none, C("mid")), entry(3, "single", None, "c7", C("one"), none))).alias("x")).select("title_id", "x.*")
    return characters.apply_corrections(lines, log).select("title_id", "seq", "character_id")


_OPS = {"remove": "= 0", "merge": "= 1", "split": "in (2, 3)", "forward": "in (4, 5, 6)", "single": "> 6"}
_OP = "case " + " ".join(f"when k % 10 {test} then '{op}'" for op, test in _OPS.items()) + " end"


@query(f"""WITH RECURSIVE {EV}, l AS (SELECT title_id, start_ms // {HOUR} AS seq, start_ms AS at_ms, 'c' || CAST(user_id % 7 AS VARCHAR) AS c, 's' || CAST(k % 3 AS VARCHAR) AS s FROM ev WHERE source = 'view'),
g AS (SELECT title_id, {_OP} AS op, 'c' || CAST(user_id % 7 AS VARCHAR) AS a, 'c' || CAST(user_id // 7 % 7 AS VARCHAR) AS b, start_ms // {HOUR} AS line, start_ms AS since, 's' || CAST(user_id % 3 AS VARCHAR) AS s, row_number() OVER (PARTITION BY title_id ORDER BY seq) AS n, count(*) OVER (PARTITION BY title_id) AS z FROM ev WHERE source = 'signup'),
r AS (SELECT title_id, seq, at_ms, s, c, CAST(0 AS BIGINT) AS n, row_number() OVER () AS i FROM l UNION ALL SELECT r.title_id, r.seq, r.at_ms, r.s,
 CASE WHEN CASE g.op WHEN 'single' THEN g.line = r.seq WHEN 'forward' THEN r.c = g.a AND r.at_ms >= g.since WHEN 'split' THEN r.c = g.a AND r.s = g.s ELSE r.c = g.a END THEN CASE WHEN g.op <> 'remove' THEN g.b END ELSE r.c END, g.n, r.i FROM r JOIN g ON g.title_id = r.title_id AND g.n = r.n + 1)
SELECT title_id, seq, at_ms, arg_max({{"c": c}}, n).c AS character_id FROM r GROUP BY i, title_id, seq, at_ms""")
def p12_corrections_log(spark, sf_dir):
    """Lines, known by the hour they are in, after a log of all kinds of corrections."""
    e = evidence(spark, sf_dir)
    name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    hour = F.floor(C("start_ms") / HOUR)
    lines = e.where("source = 'view'").select("title_id", hour.alias("seq"), C("start_ms").alias("at_ms"), name("c", C("user_id") % 7).alias("character_id"), name("s", C("k") % 3).alias("speaker_id"))
    log = e.where("source = 'signup'").select("title_id", C("seq").alias("log_seq"), F.expr(_OP).alias("op"), name("c", C("user_id") % 7).alias("from_id"), name("c", F.floor(C("user_id") / 7) % 7).alias("to_id"), hour.alias("line_seq"), C("start_ms").alias("at_ms"), name("s", C("user_id") % 3).alias("speaker_id"))
    return characters.apply_corrections(lines, log)


@query()
def p21_request_table(spark, sf_dir):
    e = evidence(spark, sf_dir)
    w = e.where("source = 'purchase'").select("title_id", "seq", "start_ms", "end_ms")
    lines = e.where("source = 'view'").select("title_id", C("seq").alias("r_seq"), C("start_ms").alias("r_start"), C("end_ms").alias("r_end"))
    return requests.request_table(w, lines, _moments(e, "signup"), _moments(e, "click"), HOUR, 50 * HOUR, 12 * HOUR)


def pcm(spark, sf_dir):
    """Embeddings as PCM chunks: each vector eight times over, a title for each label."""
    x = table(spark, sf_dir, "embeddings")
    return x.select(C("label").cast("long").alias("title_id"), C("vec_id").alias("chunk"), (C("vec_id") * 32).alias("start_ms"), F.lit(16000).alias("sample_rate"), F.flatten(F.array_repeat("embedding", 8)).alias("samples"))


@query("""WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT vec_id AS chunk, round(greatest(-100, 20 * log10(greatest(sqrt(avg(x * x)), 1e-5))), 6) AS db FROM v GROUP BY vec_id""")
def p15_audio_features(spark, sf_dir):
    from ..plans.signals import audio_features

    return audio_features(pcm(spark, sf_dir)).select("chunk", F.round("db", 6).alias("db"))


@query()
def p15_audio_spectra(spark, sf_dir):
    from ..plans.signals import audio_features

    return audio_features(pcm(spark, sf_dir)).select("chunk", *[F.round(c, 4).alias(c) for c in ("zcr", "centroid", "flatness", "spectrum_sum")], F.size("mfcc").alias("n_mfcc"))


def _pcm_rows(spark, sf_dir):
    """The same chunks without pauses, a title for each label, as two channels: the vector, and half of it."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    x = table(spark, sf_dir, "embeddings").select(C("label").cast("long").alias("title_id"), C("vec_id").alias("chunk"), (place * 512).cast("long").alias("first_sample"), F.lit(16000).alias("sample_rate"), F.flatten(F.array_repeat("embedding", 8)).alias("one"))
    return x.select("title_id", "chunk", "first_sample", "sample_rate", F.flatten(F.transform("one", lambda v: F.array(v.cast("double"), v.cast("double") / 2))).alias("both"))


@query("""WITH c AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings), v AS (SELECT label, n, CAST(unnest(embedding) AS DOUBLE) * 0.75 AS x, unnest(range(0, 64)) AS i FROM c),
s AS (SELECT label, x, n * 512 + i + 64 * unnest(range(0, 8)) AS spot FROM v), z AS (SELECT label, max(spot) + 1 AS size FROM s GROUP BY label), o AS (SELECT label, size, unnest(range(0, size * 3 // 4)) AS j FROM z),
y AS (SELECT o.label, o.j, a.x * (1 - o.j * 4 % 3 / 3.0) + coalesce(b.x, a.x) * (o.j * 4 % 3 / 3.0) AS x FROM o JOIN s a ON a.label = o.label AND a.spot = o.j * 4 // 3 LEFT JOIN s b ON b.label = o.label AND b.spot = o.j * 4 // 3 + 1),
p AS (SELECT label, j, x, lag(x) OVER (PARTITION BY label ORDER BY j) AS before FROM y), f AS (SELECT label, j, x, before, j // 120 - unnest(range(0, 3)) AS frame FROM p)
SELECT CAST(label AS BIGINT) AS title_id, CAST(frame AS BIGINT) AS frame, CAST(frame * 10 AS BIGINT) AS start_ms, round(greatest(-100, 20 * log10(greatest(sqrt(avg(x * x)), 1e-5))), 6) AS db, round(count(*) FILTER (WHERE j > frame * 120 AND (x >= 0) <> (before >= 0)) / 299, 6) AS zcr
FROM f WHERE frame >= 0 AND j < frame * 120 + 300 GROUP BY label, frame HAVING count(*) = 300""")
def p15_audio_frames(spark, sf_dir):
    """Two channels at 16 kHz as one at 12 kHz, in frames of 25 ms each 10 ms over the borders of chunks."""
    from ..plans.signals import audio_frames, downmix

    f = audio_frames(_pcm_rows(spark, sf_dir).withColumn("samples", downmix("both", 2)), 12_000, 300, 120)
    return f.select("title_id", "frame", "start_ms", F.round("db", 6).alias("db"), F.round("zcr", 6).alias("zcr"))


@query()
def p15_frame_spectra(spark, sf_dir):
    from ..plans.signals import audio_frames, downmix

    return audio_frames(_pcm_rows(spark, sf_dir).withColumn("samples", downmix("both", 2))).select("title_id", "frame", "flux", "centroid", "flatness", "mfcc")


@query("""WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings), l AS (SELECT vec_id, i, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT) AS y FROM v), b AS (SELECT vec_id, (i // 8) // 2 AS r, (i % 8) // 2 AS c, floor(avg(y) + 0.5) AS m FROM l GROUP BY 1, 2, 3)
SELECT vec_id AS seq, CAST(sum(m) AS BIGINT) AS total FROM b GROUP BY vec_id""")
def p16_frame_signatures(spark, sf_dir):
    from ..plans.signals import frame_signatures

    grey = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    x = table(spark, sf_dir, "embeddings").select(C("vec_id").alias("seq"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.flatten(F.transform(grey, lambda v: F.array(v, v, v, F.lit(255)))).alias("rgba"))
    return frame_signatures(x, 4, 4).select("seq", F.aggregate("luma", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query("WITH v AS (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS i FROM embeddings), s AS (SELECT label, vec_id, x, i + 64 * unnest(range(0, 8)) AS spot FROM v) SELECT CAST(label AS BIGINT) AS title_id, vec_id AS seq, count(*) AS n, count(*) FILTER (WHERE x >= 0) AS positive FROM s WHERE spot >= 80 AND spot < 400 GROUP BY label, vec_id")
def p19_slice_pcm(spark, sf_dir):
    from ..plans.signals import slice_pcm

    chunks = pcm(spark, sf_dir)
    w = chunks.select("title_id", C("chunk").alias("seq"), (C("start_ms") + 5).alias("start_ms"), (C("start_ms") + 25).alias("end_ms"))
    cut = slice_pcm(chunks, w)
    return cut.select("title_id", "seq", F.size("samples").alias("n"), F.size(F.filter("samples", lambda x: x >= 0)).alias("positive"))
