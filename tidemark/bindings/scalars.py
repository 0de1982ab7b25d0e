"""Scalar functions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..functions import labels, text, time
from ..registry import query
from .views import EV, LEVEL, WITH, evidence, table

C = F.col
_INV, _SP, _PU = text.INVISIBLE, text.SPACES, text.PUNCTUATION.replace("'", "''")
_CLEAN = f"trim(regexp_replace(regexp_replace(text, '{_INV}', '', 'g'), '{_SP}', ' ', 'g'))"


def _comparable(column: str) -> str:
    marks = f"regexp_replace(regexp_replace(lower(regexp_replace({column}, '{_INV}', '', 'g')), '[\\x{{2018}}\\x{{2019}}\\x{{02BC}}]', '''', 'g'), '[\\x{{201C}}\\x{{201D}}]', '\"', 'g')"
    return f"trim(regexp_replace(regexp_replace({marks}, '{_PU}', '', 'g'), '{_SP}', ' ', 'g'))"


@query(f"SELECT doc_id, length(regexp_replace(text, '{_INV}', '', 'g')) AS visible, md5({_CLEAN}) AS collapsed, md5({_comparable('text')}) AS comparable FROM documents")
def x1_x3_text_forms(spark, sf_dir):
    t = C("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.strip_invisible(t)).cast("long").alias("visible"), F.md5(text.collapse_whitespace(text.strip_invisible(t))).alias("collapsed"), F.md5(text.comparable_ascii(t)).alias("comparable"))


@query()
def x3_comparable_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.comparable_text(C("text"))).alias("comparable"))


def _turns(spark, sf_dir):
    """Turns of conversations, each with the next of its conversation."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.comparable_ascii(C("text")).alias("a"))
    # SQL's edit distance counts bytes, so letters beyond ASCII are one sign here
    a = a.withColumn("a", F.regexp_replace("a", r"[^\x00-\x7F]", "?"))
    b = a.select("conv_id", (C("turn") - 1).alias("turn"), C("a").alias("b"))
    return a.join(b, ["conv_id", "turn"])


_TURNS = f"t AS (SELECT conv_id, turn, regexp_replace({_comparable('text')}, '[^\\x00-\\x7F]', '?', 'g') AS a FROM conversations), p AS (SELECT x.conv_id, x.turn, x.a, y.a AS b FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"


@query(f"WITH {_TURNS} SELECT conv_id, turn, CASE WHEN length(a) = 0 THEN length(b) > 0 ELSE length(b) > length(a) AND starts_with(b, a) AND substr(b, length(a) + 1, 1) = ' ' END AS progressive FROM p")
def x4_progressive_extension(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", text.is_progressive_extension(C("a"), C("b")).alias("progressive"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, CASE WHEN a = b THEN 1.0 WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE round(1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE), 9) END AS similarity FROM p")
def x5_text_similarity(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(text.text_similarity(C("a"), C("b")), 9).alias("similarity"))


@query(f"SELECT doc_id, regexp_matches(text, '{text.CJK}') AS cjk, upper({_CLEAN}) = {_CLEAN} AS is_cue FROM documents")
def x6_x8_cjk_and_cue(spark, sf_dir):
    t = text.strip_invisible(C("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.contains_cjk(C("text")).alias("cjk"), (text.to_character_cue(t) == text.collapse_whitespace(t)).alias("is_cue"))


@query(r"SELECT doc_id, coalesce(nullif(rtrim(substr(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'untitled') AS slug FROM documents")
def x7_slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.slugify(C("text")).alias("slug"))


@query(r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[\t\n\f\r \x{0B}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS sentences FROM documents")
def x9_split_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.split_sentences(C("text"))).cast("long").alias("sentences"))


@query(f"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '{_INV}', '', 'g'), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '{_SP}', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents) SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, md5(array_to_string(lines, ' ')) AS joined FROM l")
def x10_normalize_caption(spark, sf_dir):
    lines = text.normalized_lines(C("text"))
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", " ")).alias("joined"))


@query(r"WITH l AS (SELECT conv_id, turn, ['- ' || text, '– ' || role] AS lines FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, [text, '- ' || role] FROM conversations WHERE turn % 2 = 1), p AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN list_transform(lines, lambda x: trim(regexp_replace(x, '^[-–—]\s*', ''))) ELSE [array_to_string(lines, ' ')] END AS parts FROM l) SELECT conv_id, turn, unnest(parts) AS part FROM p")
def x11_split_dashed_lines(spark, sf_dir):
    even = C("turn") % 2 == 0
    lines = F.when(even, F.array(F.concat(F.lit("- "), C("text")), F.concat(F.lit("– "), C("role")))).otherwise(F.array(C("text"), F.concat(F.lit("- "), C("role"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.split_dashed_lines(lines)).alias("part"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN upper(role) END AS speaker, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE role || ': ' || trim(text) END AS remainder FROM conversations WHERE trim(text) <> ''")
def x12_speaker_label(spark, sf_dir):
    said = F.concat(F.when(C("turn") % 2 == 0, F.upper("role")).otherwise(C("role")), F.lit(": "), F.trim("text"))
    speaker, rest = text.speaker_label(said)
    return table(spark, sf_dir, "conversations").where("trim(text) <> ''").select("conv_id", "turn", speaker.alias("speaker"), rest.alias("remainder"))


@query(
    "WITH c AS (SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 THEN '[' || role || ']' WHEN turn % 3 = 1 THEN '[' || role || '] ' || text ELSE text END) AS t FROM conversations), "
    "p AS (SELECT *, left(t, 1) AS first, least(coalesce(nullif(strpos(t, ']'), 0), length(t) + 1), coalesce(nullif(strpos(t, ')'), 0), length(t) + 1)) AS closed FROM c) "
    "SELECT conv_id, turn, coalesce(first IN ('[', '(') AND closed = length(t) OR first = '\u266a' AND NOT contains(t, chr(10)) AND closed >= length(t), false) AS non_speech FROM p"
)
def x13_non_speech(spark, sf_dir):
    t = F.when(C("turn") % 3 == 0, F.concat(F.lit("["), C("role"), F.lit("]"))).when(C("turn") % 3 == 1, F.concat(F.lit("["), C("role"), F.lit("] "), C("text"))).otherwise(C("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_non_speech(t).alias("non_speech"))


@query(r"SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN '' WHEN regexp_matches(trim(text), '[.!?]$') THEN upper(substr(trim(text), 1, 1)) || substr(trim(text), 2) ELSE upper(substr(trim(text), 1, 1)) || substr(trim(text), 2) || '.' END AS sentence, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS short FROM conversations")
def x14_x15_sentence_and_truncate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.capitalize_sentence(C("text")).alias("sentence"), text.truncate(C("text")).alias("short"))


_TWO = "lpad(CAST({} AS VARCHAR), 2, '0')"
_HMS = "(ms // 3600000)", "(ms % 3600000 // 60000)", "(ms % 60000 // 1000)"


@query(f"""{WITH}, m AS (SELECT seq, abs(end_ms - start_ms) AS ms FROM ev)
SELECT seq, CASE WHEN ms >= 3600000 THEN CAST({_HMS[0]} AS VARCHAR) || ':' || {_TWO.format(_HMS[1])} ELSE CAST({_HMS[1]} AS VARCHAR) END || ':' || {_TWO.format(_HMS[2])} || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS timecode,
{_TWO.format(_HMS[0])} || ':' || {_TWO.format(_HMS[1])} || ':' || {_TWO.format(_HMS[2])} || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS srt FROM m""")
def x16_x17_timecodes(spark, sf_dir):
    ms = C("end_ms") - C("start_ms")
    return evidence(spark, sf_dir).select("seq", time.format_timecode(ms, millis=True).alias("timecode"), time.format_srt_timestamp(ms).alias("srt"))


@query(f"""WITH {EV}, p AS (SELECT seq, start_ms AS s1, end_ms AS e1, lead(start_ms) OVER w AS s2, lead(end_ms) OVER w AS e2 FROM ev WINDOW w AS (PARTITION BY title_id ORDER BY start_ms, seq))
SELECT seq, s1 < e2 AND s2 < e1 AS overlapping, greatest(0, least(e1, e2) - greatest(s1, s2)) AS shared_ms, CASE WHEN least(e1, e2) - greatest(s1, s2) <= 0 THEN 0.0 ELSE (least(e1, e2) - greatest(s1, s2)) / CAST(greatest(e1, e2) - least(s1, s2) AS DOUBLE) END AS iou, greatest(-100, least(100, k)) AS clamped FROM p JOIN ev USING (seq) WHERE s2 IS NOT NULL""")
def x18_x19_overlap_measures(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("title_id").orderBy("start_ms", "seq")
    e = evidence(spark, sf_dir).withColumns({"s2": F.lead("start_ms").over(w), "e2": F.lead("end_ms").over(w)}).where("s2 is not null")
    args = C("start_ms"), C("end_ms"), C("s2"), C("e2")
    return e.select("seq", time.overlaps(*args).alias("overlapping"), time.overlap_ms(*args).alias("shared_ms"), time.iou(*args).alias("iou"), time.clamp(C("k"), -100, 100).alias("clamped"))


@query(f"{WITH} SELECT seq, {LEVEL.format('rank')} AS confidence, CAST(rank AS INT) AS rank, {LEVEL.format('greatest(0, rank - 1)')} AS inferred, CASE WHEN rank = 0 THEN 'Confidence unknown' ELSE CASE rank WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END || ' confidence' END AS said FROM ev")
def x20_x23_confidence(spark, sf_dir):
    c = C("confidence")
    return evidence(spark, sf_dir).select("seq", "confidence", conf.confidence_rank(c).alias("rank"), conf.derive(c).alias("inferred"), conf.describe(c).alias("said"))


_KINDS = ["door", "phone", "glass", "laughter", "music-end"]


@query(f"""WITH {EV} SELECT seq, CASE WHEN end_ms - start_ms >= 8000 THEN 'A long silence.' WHEN end_ms - start_ms >= 4000 THEN 'Silence.' ELSE 'A pause.' END AS silence,
CASE k % 5 WHEN 0 THEN 'A door opens.' WHEN 1 THEN 'A phone rings.' WHEN 2 THEN 'Glass breaks.' WHEN 3 THEN 'Laughter.' ELSE 'The music fades.' END AS sound FROM ev""")
def x23_phrases(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (C("k") % 5 + 1).cast("int"))
    return evidence(spark, sf_dir).select("seq", labels.describe_silence(C("end_ms") - C("start_ms")).alias("silence"), labels.describe_sound(kind, F.lit(None).cast("string")).alias("sound"))


@query(f"{WITH} SELECT seq, source <> 'view' AND k < 0 AS purely_inferred FROM ev")
def x24_purely_inferred(spark, sf_dir):
    return evidence(spark, sf_dir).select("seq", ((C("source") != "view") & (C("k") < 0)).alias("purely_inferred"))


@query(r"""WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'INT. ' WHEN 1 THEN 'Outside, ' ELSE '' END || p_name || CASE p_size % 3 WHEN 0 THEN ' - night' WHEN 1 THEN ', MORNING.' ELSE '' END AS d FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(trim(d), '^(?i)(int|ext|interior|exterior)\.?[\s,:-]+', ''), '(?i)[\s,-]+(day|night|dawn|dusk|morning|afternoon|evening|sunset|sunrise)\.?$', ''), '\s+', ' ', 'g')) AS place,
CASE WHEN regexp_matches(d, '(?i)\b(int\.?|interior|indoors?|inside)\b') THEN 'INT' WHEN regexp_matches(d, '(?i)\b(ext\.?|exterior|outdoors?|outside|street|park|forest|beach)\b') THEN 'EXT' END AS int_ext,
nullif(upper(regexp_extract(d, '(?i)\b(day|night|dawn|dusk|morning|afternoon|evening|sunset|sunrise)\b', 1)), '') AS time_of_day FROM s""")
def x25_parse_setting(spark, sf_dir):
    d = F.concat(F.when(C("p_partkey") % 3 == 0, "INT. ").when(C("p_partkey") % 3 == 1, "Outside, ").otherwise(""), C("p_name"), F.when(C("p_size") % 3 == 0, " - night").when(C("p_size") % 3 == 1, ", MORNING.").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", labels.parse_setting(d).alias("s")).select("p_partkey", "s.*")


@query("""SELECT p_partkey, trim(CASE p_size % 3 WHEN 0 THEN CASE p_partkey % 4 WHEN 1 THEN '실내. ' ELSE 'INT. ' END WHEN 1 THEN CASE p_partkey % 4 WHEN 1 THEN '실외. ' ELSE 'EXT. ' END ELSE '' END || upper(trim(p_name)) || ' - ' ||
CASE p_partkey % 4 WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN '밤' ELSE '시간 불명' END WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'NOCHE' ELSE 'HORA DESCONOCIDA' END ELSE CASE WHEN p_size % 2 = 0 THEN 'NIGHT' ELSE 'UNKNOWN TIME' END END) AS heading FROM part""")
def x26_scene_heading(spark, sf_dir):
    kind = F.when(C("p_size") % 3 == 0, "INT").when(C("p_size") % 3 == 1, "EXT").otherwise("UNKNOWN")
    lang = F.element_at(F.array(*map(F.lit, ["en", "ko", "es-MX", "xx"])), (C("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.scene_heading(C("p_name"), kind, F.when(C("p_size") % 2 == 0, "NIGHT"), lang).alias("heading"))


@query(f"{WITH} SELECT seq, md5(source || ':' || CAST(start_ms AS VARCHAR) || ':' || CAST(user_id AS VARCHAR)) AS id FROM ev")
def x27_stable_id(spark, sf_dir):
    return evidence(spark, sf_dir).select("seq", F.md5(F.concat_ws(":", "source", "start_ms", "user_id")).alias("id"))


_LABEL = "CASE p_size % 6 WHEN 0 THEN CAST(360 + 360 * (p_partkey % 4) AS VARCHAR) || 'p60' WHEN 1 THEN 'Auto (1080p)' WHEN 2 THEN '1920x1080 Premium' WHEN 3 THEN '4K HDR' WHEN 4 THEN 'Full HD 50 fps' ELSE '1080p' END"


def _label():
    s = C("p_size") % 6
    return F.when(s == 0, F.concat((360 + 360 * (C("p_partkey") % 4)).cast("string"), F.lit("p60"))).when(s == 1, "Auto (1080p)").when(s == 2, "1920x1080 Premium").when(s == 3, "4K HDR").when(s == 4, "Full HD 50 fps").otherwise("1080p")


@query("""SELECT p_partkey, CAST(CASE p_size % 6 WHEN 0 THEN 360 + 360 * (p_partkey % 4) WHEN 1 THEN NULL WHEN 2 THEN 1080 WHEN 3 THEN 2160 WHEN 4 THEN 1080 ELSE 1080 END AS INT) AS resolution,
CAST(CASE p_size % 6 WHEN 0 THEN 60 WHEN 4 THEN 50 END AS INT) AS frame_rate, p_size % 6 = 2 AS enhanced, p_size % 6 = 3 AS hdr, p_size % 6 = 1 AS auto,
CASE p_size % 6 WHEN 0 THEN CAST(360 + 360 * (p_partkey % 4) AS VARCHAR) || 'p 60fps' WHEN 1 THEN 'Unknown' WHEN 2 THEN '1080p enhanced bitrate' WHEN 3 THEN '2160p HDR' WHEN 4 THEN '1080p 50fps' ELSE '1080p' END AS said FROM part""")
def x28_x29_quality_labels(spark, sf_dir):
    q = table(spark, sf_dir, "part").select("p_partkey", labels.parse_quality(_label()).alias("q")).select("p_partkey", "q.*")
    return q.withColumn("said", labels.describe_quality(C("resolution"), C("enhanced"), C("hdr"), C("frame_rate")))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN text || '!' ELSE text || '?' END AS picked FROM benchmark")
def x30_variant_pick(spark, sf_dir):
    v = lambda t, origin: F.struct(t.alias("text"), F.lit(origin).alias("origin"))
    en, fr, asr = v(C("text"), "translated"), v(F.concat("text", F.lit("!")), "platform-subtitle"), v(F.concat("text", F.lit("?")), "audio-asr")
    k = C("item_id") % 3
    variants = F.when(k == 0, F.create_map(F.lit("en"), en, F.lit("fr"), fr)).when(k == 1, F.create_map(F.lit("de"), asr, F.lit("fr"), fr)).otherwise(F.create_map(F.lit("xx"), v(C("text"), "translated"), F.lit("de"), asr))
    order = F.when(k == 0, F.array(F.lit("en"), F.lit("fr"))).when(k == 1, F.array(F.lit("de"), F.lit("fr"))).otherwise(F.array(F.lit("xx"), F.lit("de")))
    return table(spark, sf_dir, "benchmark").select("item_id", labels.pick_variant(variants, order, F.lit("en"), ["ja"])["text"].alias("picked"))


@query("SELECT page_id, substr(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[\\x00-\\x1F\\x7F]+', '', 'g'), 1, 120) AS name, substr(trim(regexp_replace(html, '[\\x00-\\x1F\\x7F]+', ' ', 'g')), 1, 200) AS detail FROM pages")
def x33_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_filename(C("url")).alias("name"), text.sanitize_detail(C("html")).alias("detail"))


@query(f"{WITH} SELECT seq, source FROM ev WHERE NOT (source = 'error' AND rank = 0) AND NOT (source = 'view' AND rank <= 1)")
def x34_low_confidence_filter(spark, sf_dir):
    """Leaves out unclassified sounds of unknown confidence and inferred actions of low confidence."""
    r = conf.confidence_rank(C("confidence"))
    return evidence(spark, sf_dir).where(~((C("source") == "error") & (r == 0)) & ~((C("source") == "view") & (r <= 1))).select("seq", "source")


@query("SELECT p_partkey, CAST(least(2160, floor(p_size * 50 * (1 + p_partkey % 3) + 0.5)) AS BIGINT) AS ceiling, least(CAST(p_size AS DOUBLE), 24.0) AS fps FROM part")
def x35_x36_ceiling_and_fps(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.least(F.lit(2160), F.floor(C("p_size") * 50 * (1 + C("p_partkey") % 3) + 0.5)).cast("long").alias("ceiling"), F.least(C("p_size").cast("double"), F.lit(24.0)).alias("fps"))


@query(f"WITH {_TURNS}, w AS (SELECT conv_id, turn, list_filter(string_split(a, ' '), lambda x: x <> '') AS x, list_filter(string_split(a || ' ' || b, ' '), lambda x: x <> '') AS y FROM p) SELECT conv_id, turn, CAST(len(x) AS INT) AS words FROM w")
def w37_roll_up_overlap(spark, sf_dir):
    """A caption rolled up into the next: all its words begin the joined one."""
    return _turns(spark, sf_dir).select("conv_id", "turn", text.roll_up_overlap(C("a"), F.concat_ws(" ", "a", "b")).alias("words"))


@query(f"{WITH} SELECT seq, CASE k % 3 WHEN 0 THEN 'Subtitle + Audio ASR' WHEN 1 THEN 'On-screen text' ELSE 'No source' END AS said FROM ev")
def x23_describe_sources(spark, sf_dir):
    none = F.array().cast("array<string>")
    sources = F.when(C("k") % 3 == 0, F.array(F.lit("subtitle"), F.lit("audio-asr"))).when(C("k") % 3 == 1, F.array(F.lit("ocr"))).otherwise(none)
    return evidence(spark, sf_dir).select("seq", labels.describe_sources(sources).alias("said"))


@query(f"{WITH} SELECT seq, greatest(0, end_ms - start_ms) AS duration_ms, CAST(floor(value * 1000 + 0.5) AS BIGINT) AS rounded_ms FROM ev")
def x18_durations(spark, sf_dir):
    return evidence(spark, sf_dir).select("seq", F.greatest(F.lit(0), C("end_ms") - C("start_ms")).alias("duration_ms"), time.seconds_to_ms(C("value")).alias("rounded_ms"))
