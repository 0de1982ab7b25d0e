"""SQL of the stateful rules: a row for each step of a title's recursion, with the state that it leaves."""

from __future__ import annotations

from .views import EV, MEDIA

HOUR = 3_600_000


def recursion(rows: str, order: str, start: str, step: str, then: str, before: str = "", base: str = EV) -> str:
    """rows: a table expression x; order: its order within a title; start: the state before the first row; step: what a row makes of it.

    In step, o is the row and r the state before; then selects from r, in which n = 0 is the start and z the last row's number.
    """
    ordered = f"o AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY {order}) AS n, count(*) OVER (PARTITION BY title_id) AS z FROM ({rows}) x)"
    r = f"r AS (SELECT DISTINCT title_id, CAST(0 AS BIGINT) AS n, z, {start} FROM o UNION ALL SELECT o.title_id, o.n, o.z, {step} FROM r JOIN o ON o.title_id = r.title_id AND o.n = r.n + 1)"
    return f"WITH RECURSIVE {base}, {before}{ordered}, {r} {then}"


_KNOWN = "SELECT title_id, seq, start_ms AS at_ms, CASE WHEN k % 4 = 1 OR k % 10 = 2 OR k % 10 = 4 THEN 'character-' || CAST(user_id % 3 AS VARCHAR) END AS known, CASE WHEN k % 4 = 1 THEN 'label' WHEN k % 10 = 2 THEN 'user' WHEN k % 10 = 4 THEN 'diarization' END AS ladder, CASE WHEN k % 4 = 1 OR k % 10 = 2 THEN 'high' ELSE 'medium' END AS level, CASE WHEN k % 2 = 0 THEN ['character-0', 'character-1'] ELSE ['character-2'] END AS present FROM media WHERE source = 'subtitle'"
_OTHER = "CASE WHEN o.known IS NULL AND len(o.present) = 2 AND list_contains(o.present, r.last) THEN list_filter(o.present, lambda p: p <> r.last)[1] END"
ATTRIBUTION = recursion(
    _KNOWN, "at_ms, seq", "CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS who, CAST(NULL AS VARCHAR) AS how, CAST(NULL AS VARCHAR) AS sure, CAST(NULL AS VARCHAR) AS last",
    f"o.seq, coalesce(o.known, {_OTHER}), CASE WHEN o.known IS NOT NULL THEN o.ladder WHEN {_OTHER} IS NOT NULL THEN 'alternation' ELSE 'unknown' END, CASE WHEN o.known IS NOT NULL THEN o.level WHEN {_OTHER} IS NOT NULL THEN 'low' ELSE 'unknown' END, coalesce(o.known, {_OTHER}, r.last)",
    "SELECT title_id, seq, who AS character_id, how AS attribution, sure AS confidence FROM r WHERE n > 0", base=MEDIA,
)

# state: floor, two crossings before, the open region (begin, till, total, n, peak), and what a step closes (e_...)
_NONE = "CAST(NULL AS DOUBLE)"
_LOUD = "(o.db - coalesce(r.floor, o.db) >= 9 AND (CASE WHEN r.z1 IS NULL THEN o.zcr WHEN r.z2 IS NULL THEN (r.z1 + o.zcr) / 2 ELSE (r.z2 + r.z1 + o.zcr) / 3 END) <= 0.45)"
_QUIET = f"(NOT {_LOUD} AND r.till IS NOT NULL AND o.at_ms - r.till >= 300)"
_KEEP = "CASE WHEN {loud} THEN {new} WHEN {quiet} THEN NULL ELSE r.{name} END"
_region = lambda name, new: _KEEP.format(loud=_LOUD, quiet=_QUIET, name=name, new=new)
SPEECH = recursion(
    "SELECT title_id, seq, start_ms // 600000 * 20 AS at_ms, value / 4 - 60 AS db, k / 250.0 AS zcr FROM ev", "at_ms, seq",
    f"{_NONE} AS floor, {_NONE} AS z1, {_NONE} AS z2, CAST(NULL AS BIGINT) AS begin, CAST(NULL AS BIGINT) AS till, {_NONE} AS total, CAST(NULL AS BIGINT) AS m, {_NONE} AS peak, CAST(NULL AS BIGINT) AS e_begin, CAST(NULL AS BIGINT) AS e_till, {_NONE} AS e_mean, {_NONE} AS e_peak",
    f"""CASE WHEN {_LOUD} THEN coalesce(r.floor, o.db) ELSE coalesce(r.floor, o.db) + (o.db - coalesce(r.floor, o.db)) * CAST(CASE WHEN o.db < coalesce(r.floor, o.db) THEN 0.12 ELSE 0.03 END AS DOUBLE) END, o.zcr, r.z1,
 {_region("begin", "coalesce(r.begin, o.at_ms)")}, {_region("till", "o.at_ms")}, {_region("total", "coalesce(r.total, 0) + o.db - coalesce(r.floor, o.db)")}, {_region("m", "coalesce(r.m, 0) + 1")}, {_region("peak", "greatest(coalesce(r.peak, -100), o.db)")},
 CASE WHEN {_QUIET} THEN r.begin END, CASE WHEN {_QUIET} THEN r.till END, CASE WHEN {_QUIET} THEN r.total / r.m END, CASE WHEN {_QUIET} THEN r.peak END""",
    """, a AS (SELECT title_id, e_begin AS start_ms, e_till + 20 AS end_ms, e_mean AS mean_excess_db, e_peak AS peak_db FROM r WHERE e_begin IS NOT NULL UNION ALL SELECT title_id, begin, till + 20, total / m, peak FROM r WHERE n = z AND begin IS NOT NULL)
SELECT * FROM a WHERE end_ms - start_ms >= 140""",
)

_TONAL = "(CASE WHEN o.flatness < 0.16 AND o.level > r.background - 6 AND o.level > -50 THEN r.tonal + 1 ELSE greatest(0, r.tonal - 1) END)"
_RISE, _DUE = "(o.level - r.background)", "(r.last IS NULL OR o.at_ms - r.last >= 250)"
_MUSIC = f"CASE WHEN r.background IS NULL THEN NULL WHEN NOT r.music AND {_TONAL} > 62.5 THEN 'music-start' WHEN r.music AND {_TONAL} = 0 THEN 'music-end' END"
ONSETS = recursion(
    "SELECT title_id, seq, start_ms // 600000 * 32 AS at_ms, value / 4 - 45 AS level, k / 300.0 AS flatness, k * 30.0 AS centroid, value / 10 AS flux FROM ev", "at_ms, seq",
    f"CAST(NULL AS BIGINT) AS at_ms, {_NONE} AS background, CAST(NULL AS BIGINT) AS last, false AS music, CAST(0 AS BIGINT) AS tonal, CAST(NULL AS VARCHAR) AS turn, false AS hit, {_NONE} AS rise, {_NONE} AS attack, {_NONE} AS centroid, {_NONE} AS flatness",
    f"""o.at_ms, CASE WHEN r.background IS NULL THEN o.level WHEN {_RISE} < 10 THEN r.background + {_RISE} * CAST(0.05 AS DOUBLE) ELSE r.background END,
 CASE WHEN r.background IS NOT NULL AND {_RISE} >= 10 AND {_DUE} THEN o.at_ms ELSE r.last END, CASE {_MUSIC} WHEN 'music-start' THEN true WHEN 'music-end' THEN false ELSE r.music END,
 CASE WHEN r.background IS NULL THEN 0 ELSE {_TONAL} END, {_MUSIC}, coalesce(r.background IS NOT NULL AND {_RISE} >= 10 AND {_DUE}, false), {_RISE}, least(1, o.flux / 20), o.centroid, o.flatness""",
    "SELECT title_id, at_ms, turn AS kind, rise AS prominence_db, CAST(0 AS DOUBLE) AS attack, CAST(0 AS DOUBLE) AS centroid, flatness FROM r WHERE turn IS NOT NULL UNION ALL SELECT title_id, at_ms, 'onset', rise, attack, centroid, flatness FROM r WHERE hit",
)

_OBSERVED = "SELECT title_id, seq, start_ms // 60000 AS at_ms, least(1, value / 40) AS importance, least(1, value / 80) AS motion, CASE WHEN k % 10 = 0 THEN 0.7 ELSE 0.1 END AS cut FROM ev"
# what a row needs of the state comes first, then what it decides
_ROOM = "(CASE WHEN r.filled IS NOT NULL AND o.at_ms > r.filled THEN least(10, r.tokens + (o.at_ms - r.filled) / 1000) ELSE r.tokens END)"
_HOT = "(o.importance >= 0.55 OR coalesce(o.at_ms <= r.until, false))"
_PACE = f"(CASE WHEN {_HOT} THEN 100 ELSE 1000 END)"
_REASON = f"""CASE WHEN o.cut >= 0.6 AND {_ROOM} >= 1 AND coalesce(o.at_ms - r.last >= {_PACE} / 2, true) THEN 'scene-cut' WHEN o.importance < 0.15 THEN 'below-threshold' WHEN coalesce(o.at_ms - r.last < {_PACE}, false) THEN 'rate-limited'
 WHEN {_ROOM} < 1 THEN 'budget-exhausted' WHEN {_HOT} THEN 'promoted-window' ELSE 'baseline-budget' END"""
_TAKEN = f"({_REASON} IN ('scene-cut', 'promoted-window', 'baseline-budget'))"
SAMPLING = recursion(
    _OBSERVED, "at_ms, seq", "CAST(NULL AS BIGINT) AS seq, CAST(10 AS DOUBLE) AS tokens, CAST(NULL AS BIGINT) AS filled, CAST(NULL AS BIGINT) AS until, CAST(NULL AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS reason, false AS promoted",
    f"o.seq, CASE WHEN {_TAKEN} THEN greatest(0, {_ROOM} - 1) ELSE {_ROOM} END, o.at_ms, CASE WHEN o.importance >= 0.55 THEN o.at_ms + 2000 ELSE r.until END, CASE WHEN {_TAKEN} THEN o.at_ms ELSE r.last END, {_REASON}, {_HOT}",
    "SELECT title_id, seq, reason IN ('scene-cut', 'promoted-window', 'baseline-budget') AS analyze, reason, tokens, promoted FROM r WHERE n > 0",
)

_ENDS = "(r.begin IS NOT NULL AND (o.cut >= 0.6 OR o.at_ms - r.till > 700 OR o.at_ms - r.begin > 8000))"
_GOES_ON = f"(r.begin IS NOT NULL AND NOT {_ENDS})"
_OPENS = "(o.importance >= 0.18 OR o.cut >= 0.6)"
_seg = lambda on, new: f"CASE WHEN {_GOES_ON} THEN {on} WHEN {_OPENS} THEN {new} END"
_SEGMENTS = f"""o AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY at_ms, seq) AS n, count(*) OVER (PARTITION BY title_id) AS z FROM ({_OBSERVED}) x),
r AS (SELECT DISTINCT title_id, CAST(0 AS BIGINT) AS n, z, CAST(NULL AS BIGINT) AS begin, CAST(NULL AS BIGINT) AS till, CAST(NULL AS BIGINT) AS m, {_NONE} AS peak, {_NONE} AS moved, false AS on_cut,
 CAST(NULL AS BIGINT) AS e_begin, CAST(NULL AS BIGINT) AS e_till, CAST(NULL AS BIGINT) AS e_m, {_NONE} AS e_peak, {_NONE} AS e_moved, false AS e_cut FROM o
 UNION ALL SELECT o.title_id, o.n, o.z, {_seg("r.begin", "o.at_ms")}, {_seg("CASE WHEN o.importance >= 0.1 THEN o.at_ms ELSE r.till END", "o.at_ms")}, {_seg("r.m + 1", "1")}, {_seg("greatest(r.peak, o.importance)", "o.importance")}, {_seg("r.moved + o.motion", "o.motion")}, {_seg("r.on_cut", "o.cut >= 0.6")},
 CASE WHEN {_ENDS} THEN r.begin END, CASE WHEN {_ENDS} THEN r.till END, CASE WHEN {_ENDS} THEN r.m END, CASE WHEN {_ENDS} THEN r.peak END, CASE WHEN {_ENDS} THEN r.moved END, CASE WHEN {_ENDS} THEN r.on_cut END FROM r JOIN o ON o.title_id = r.title_id AND o.n = r.n + 1),
seg AS (SELECT title_id, e_begin AS start_ms, greatest(e_till, e_begin + 100) AS end_ms, e_m AS events, e_peak AS peak, e_moved / e_m AS motion, e_cut AS on_cut FROM r WHERE e_begin IS NOT NULL
 UNION ALL SELECT title_id, begin, greatest(till, begin + 100), m, peak, moved / m, on_cut FROM r WHERE n = z AND begin IS NOT NULL)"""
SEGMENTS = f"WITH RECURSIVE {EV}, {_SEGMENTS} SELECT * FROM seg"
_JOINS = "(r.begin IS NOT NULL AND NOT o.on_cut AND o.start_ms - r.till <= 900)"
_merge = lambda on, new: f"CASE WHEN {_JOINS} THEN {on} ELSE {new} END"
MERGED = f"""WITH RECURSIVE {EV}, {_SEGMENTS}, o2 AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY start_ms, end_ms, peak, motion, on_cut) AS n, count(*) OVER (PARTITION BY title_id) AS z FROM seg),
r2 AS (SELECT DISTINCT title_id, CAST(0 AS BIGINT) AS n, z, CAST(NULL AS BIGINT) AS begin, CAST(NULL AS BIGINT) AS till, {_NONE} AS peak, {_NONE} AS motion, CAST(0 AS BIGINT) AS pauses, CAST(0 AS BIGINT) AS m, false AS closes,
 CAST(NULL AS BIGINT) AS e_begin, CAST(NULL AS BIGINT) AS e_till, {_NONE} AS e_peak, {_NONE} AS e_motion, CAST(0 AS BIGINT) AS e_pauses, CAST(0 AS BIGINT) AS e_m FROM o2
 UNION ALL SELECT o.title_id, o.n, o.z, {_merge("r.begin", "o.start_ms")}, o.end_ms, {_merge("greatest(r.peak, o.peak)", "o.peak")}, {_merge("(r.motion + o.motion) / 2", "o.motion")}, {_merge("r.pauses + CASE WHEN o.start_ms - r.till >= 250 THEN 1 ELSE 0 END", "0")}, {_merge("r.m + 1", "1")}, NOT {_JOINS} AND r.begin IS NOT NULL,
 r.begin, r.till, r.peak, r.motion, r.pauses, r.m FROM r2 r JOIN o2 o ON o.title_id = r.title_id AND o.n = r.n + 1)
SELECT title_id, e_begin AS start_ms, e_till AS end_ms, e_peak AS peak, e_motion AS motion, e_pauses AS hesitations, e_m AS segments FROM r2 WHERE closes UNION ALL SELECT title_id, begin, till, peak, motion, pauses, m FROM r2 WHERE n = z AND n > 0"""

# padded ranges stay apart, so their parts do not depend on what was planned; only the budget runs on
_LONGEST, _BUDGET = HOUR // 4, 400 * HOUR
_RANGES = """v AS (SELECT title_id, start_ms, greatest(start_ms, end_ms) AS end_ms FROM ev WHERE source = 'view'), v1 AS (SELECT *, max(end_ms) OVER (PARTITION BY title_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
v2 AS (SELECT *, sum(CASE WHEN start_ms <= reach + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY title_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM v1), v3 AS (SELECT title_id, greatest(0, min(start_ms) - 120) AS a, max(end_ms) + 120 AS b FROM v2 GROUP BY title_id, island), """
_PARTS = f"SELECT title_id, a, b, unnest(range(CASE WHEN b - a < 320 THEN 1 ELSE CAST(ceil((b - a) / {_LONGEST}) AS BIGINT) END)) AS part, CASE WHEN b - a < 320 THEN 1 ELSE CAST(ceil((b - a) / {_LONGEST}) AS BIGINT) END AS parts FROM v3"
_LOW, _HIGH = "CAST(floor(o.a + o.part * ((o.b - o.a) / o.parts) + 0.5) AS BIGINT)", "CASE WHEN o.part = o.parts - 1 THEN o.b ELSE CAST(floor(o.a + (o.part + 1) * ((o.b - o.a) / o.parts) + 0.5) AS BIGINT) END"
_STATE = f"CASE WHEN o.b - o.a < 320 THEN 'too-short' WHEN r.total + {_HIGH} - {_LOW} > {_BUDGET} THEN 'over-budget' ELSE 'planned' END"
SPEECH_PLAN = recursion(
    _PARTS, "a, part", "CAST(0 AS BIGINT) AS total, CAST(NULL AS BIGINT) AS start_ms, CAST(NULL AS BIGINT) AS end_ms, false AS continuation, CAST(NULL AS VARCHAR) AS state",
    f"CASE WHEN {_STATE} = 'planned' THEN r.total + {_HIGH} - {_LOW} ELSE r.total END, {_LOW}, {_HIGH}, o.part > 0, {_STATE}", "SELECT title_id, start_ms, end_ms, continuation, state FROM r WHERE n > 0", before=_RANGES,
)

_HELD = "(len(r.planned) >= 40 OR len(list_filter(r.planned, lambda p: p <= o.at_ms AND o.at_ms <= p + {})) > 0)".format(12 * HOUR)
_FROM = f"greatest(0, least(o.at_ms - {HOUR}, o.duration_ms - {12 * HOUR}))"
DENSE_PLAN = recursion(
    "SELECT ev.title_id, seq, start_ms AS at_ms, value AS weight, d.duration_ms FROM ev JOIN (SELECT title_id, max(end_ms) AS duration_ms FROM ev GROUP BY title_id) d ON d.title_id = ev.title_id WHERE source = 'click'", "weight DESC, at_ms, seq",
    f"CAST([] AS BIGINT[]) AS planned, CAST(NULL AS BIGINT) AS start_ms, {_NONE} AS weight", f"CASE WHEN {_HELD} THEN r.planned ELSE list_append(r.planned, {_FROM}) END, CASE WHEN {_HELD} THEN NULL ELSE {_FROM} END, o.weight",
    f"SELECT title_id, start_ms, start_ms + {12 * HOUR} AS end_ms, weight AS importance FROM r WHERE start_ms IS NOT NULL",
)

_FREE = "len(list_filter(o.given, lambda p: p <= o.at_ms AND o.at_ms <= p + {})) > 0".format(6 * HOUR)
_TAKEN = f"({_HELD} OR {_FREE})"
DENSE_PLAN_GIVEN = recursion(
    "SELECT ev.title_id, seq, start_ms AS at_ms, value AS weight, d.duration_ms, d.given FROM ev JOIN (SELECT title_id, max(end_ms) AS duration_ms, list(start_ms) FILTER (WHERE source = 'view' AND k % 4 = 0) AS given FROM ev GROUP BY title_id) d ON d.title_id = ev.title_id WHERE source = 'click'", "weight DESC, at_ms, seq",
    f"CAST([] AS BIGINT[]) AS planned, CAST(NULL AS BIGINT) AS start_ms, {_NONE} AS weight", f"CASE WHEN {_TAKEN} THEN r.planned ELSE list_append(r.planned, {_FROM}) END, CASE WHEN {_TAKEN} THEN NULL ELSE {_FROM} END, o.weight",
    f"SELECT title_id, start_ms, start_ms + {12 * HOUR} AS end_ms, weight AS importance FROM r WHERE start_ms IS NOT NULL",
)

#: How much a store keeps of each source when it is over its limit.
RETENTION = {"purchase": 100, "view": 90, "click": 60, "error": 40, "signup": 20}
_ADDED = "list_append(r.held, {'score': o.score, 'start_ms': o.start_ms, 'seq': o.seq})"
EVICTED = recursion(
    "SELECT title_id, seq, start_ms, CAST(CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RETENTION.items()) + " END + rank * 2 AS DOUBLE) AS score FROM ev", "seq",
    "CAST([] AS STRUCT(score DOUBLE, start_ms BIGINT, seq BIGINT)[]) AS held", f"CASE WHEN len(r.held) >= 100 THEN list_sort({_ADDED})[11:] ELSE {_ADDED} END",
    "SELECT title_id, h.seq AS seq FROM (SELECT title_id, unnest(held) AS h FROM r WHERE n = z)",
)

_OVER = "(r.begin IS NOT NULL AND (o.at_ms >= r.begin + 240 OR o.cut >= 0.6))"
_STAYS = f"(r.begin IS NOT NULL AND NOT {_OVER})"
_FRESH = "CASE WHEN o.cut >= 0.6 THEN greatest(o.cut, 0.6) ELSE o.importance END"
CAPTURE = recursion(
    _OBSERVED, "at_ms, seq", f"CAST(0 AS BIGINT) AS m, CAST(NULL AS BIGINT) AS begin, {_NONE} AS weight, CAST(NULL AS BIGINT) AS e_begin, CAST(NULL AS BIGINT) AS e_till, {_NONE} AS e_weight",
    f"CASE WHEN NOT {_STAYS} AND r.m < 500 THEN r.m + 1 ELSE r.m END, CASE WHEN {_STAYS} THEN r.begin WHEN r.m < 500 THEN o.at_ms END, CASE WHEN {_STAYS} THEN greatest(r.weight, o.importance) WHEN r.m < 500 THEN {_FRESH} END, CASE WHEN {_OVER} THEN r.begin END, CASE WHEN {_OVER} THEN least(o.at_ms, r.begin + 240) END, CASE WHEN {_OVER} THEN r.weight END",
    "SELECT title_id, e_begin AS start_ms, e_till AS end_ms, e_weight AS importance FROM r WHERE e_begin IS NOT NULL UNION ALL SELECT title_id, begin, begin + 240, weight FROM r WHERE n = z AND begin IS NOT NULL",
)

# groups that ended stay in the list; they end at or before every later start, so they are never open again
_CUES = "SELECT title_id, seq, start_ms, end_ms, CASE WHEN source = 'view' THEN 'en' ELSE 'fr' END AS language FROM ev WHERE source IN ('view', 'click')"
_FIT = "list_position(list_transform(r.groups, lambda g: g.b > o.start_ms AND NOT list_contains(g.langs, o.language) AND least(g.b, o.end_ms) - greatest(g.a, o.start_ms) > 0 AND (least(g.b, o.end_ms) - greatest(g.a, o.start_ms)) / (greatest(g.b, o.end_ms) - least(g.a, o.start_ms)) > 0.5), true)"
_NEW = "{'a': o.start_ms, 'b': o.end_ms, 'langs': [o.language], 'cues': [o.seq]}"
_WITH = "{'a': least(g.a, o.start_ms), 'b': greatest(g.b, o.end_ms), 'langs': list_append(g.langs, o.language), 'cues': list_append(g.cues, o.seq)}"
GROUPS = recursion(
    _CUES, "start_ms, seq", "CAST([] AS STRUCT(a BIGINT, b BIGINT, langs VARCHAR[], cues BIGINT[])[]) AS groups", f"CASE WHEN coalesce({_FIT}, 0) = 0 THEN list_append(r.groups, {_NEW}) ELSE list_transform(r.groups, lambda g, i: CASE WHEN i = {_FIT} THEN {_WITH} ELSE g END) END",
    """, u AS (SELECT title_id, unnest(groups) AS g, generate_subscripts(groups, 1) - 1 AS k FROM r WHERE n = z) SELECT title_id, k AS "group", g.a AS start_ms, g.b AS end_ms, array_to_string(g.langs, ',') AS languages, array_to_string(g.cues, ',') AS cues FROM u""",
)

# stretches between hard cuts; long ones are cut in the first pause of speech that begins after the target, else at the target
_L, _T, _S, _G = 12 * HOUR, 4 * HOUR, HOUR // 2, HOUR
_PAUSE = f"""list_reduce(list_prepend({{'s': CAST(0 AS BIGINT), 'e': CAST(0 AS BIGINT), 'm': r.at_ms + {_T}, 'x': CAST(NULL AS BIGINT)}}, list_filter(r.spoken, lambda p: p.e > r.at_ms + {_T} AND p.s < r.high)),
 lambda q, p: {{'s': p.s, 'e': p.e, 'm': greatest(q.m, p.e), 'x': CASE WHEN q.x IS NULL AND p.s - q.m >= {_G} THEN q.m + (p.s - q.m) // 2 ELSE q.x END}})"""
_AT = f"coalesce(({_PAUSE}).x, CASE WHEN ({_PAUSE}).m > r.at_ms + {_T} AND ({_PAUSE}).m < r.high THEN ({_PAUSE}).m END, r.at_ms + {_T})"
_CUT = f"least(greatest({_AT}, r.at_ms + {_S}), r.high - {_S})"
WINDOWS = f"""WITH RECURSIVE {MEDIA}, ends AS (SELECT title_id, min(start_ms) AS a, max(coalesce(end_ms, start_ms)) + 1 AS b FROM media GROUP BY title_id),
cuts AS (SELECT title_id, start_ms AS low FROM media WHERE (source = 'video' AND kind = 'scene-change') OR (source = 'playback' AND kind = 'seek') UNION SELECT title_id, a FROM ends UNION SELECT title_id, b FROM ends),
st AS (SELECT * FROM (SELECT title_id, low, lead(low) OVER (PARTITION BY title_id ORDER BY low) AS high FROM cuts) x WHERE high IS NOT NULL),
sp AS (SELECT title_id, start_ms AS s, coalesce(end_ms, start_ms + 500) AS e FROM media WHERE source = 'subtitle'),
long AS (SELECT st.title_id, st.low, st.high, coalesce(list({{'s': s, 'e': e, 'm': CAST(0 AS BIGINT), 'x': CAST(NULL AS BIGINT)}} ORDER BY s, e) FILTER (WHERE s IS NOT NULL), []) AS spoken FROM st LEFT JOIN sp ON sp.title_id = st.title_id AND sp.s < st.high AND sp.e > st.low WHERE st.high - st.low > {_L} GROUP BY ALL),
r AS (SELECT title_id, low, low AS at_ms, high, spoken FROM long UNION ALL SELECT title_id, low, {_CUT}, high, spoken FROM r WHERE high - at_ms > {_L} AND {_CUT} > at_ms)
SELECT title_id, low AS start_ms, high AS end_ms FROM st WHERE high - low <= {_L} UNION ALL SELECT title_id, at_ms, coalesce(lead(at_ms) OVER (PARTITION BY title_id, low ORDER BY at_ms), high) FROM r"""

FORWARD = recursion(
    "SELECT title_id, seq, start_ms, end_ms FROM ev WHERE source = 'view'", "start_ms, seq", "CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS until, false AS kept, CAST(NULL AS BIGINT) AS start_ms",
    "o.seq, CASE WHEN r.until IS NOT NULL AND o.start_ms < r.until THEN r.until ELSE o.end_ms END, r.until IS NULL OR o.start_ms >= r.until, o.start_ms", "SELECT title_id, seq, start_ms, until AS end_ms FROM r WHERE kept",
)
