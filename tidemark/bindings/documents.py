"""Sources and sinks on data derived from the tables: conversations as subtitle files, orders as stored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import format_srt_timestamp
from ..plans import render
from ..registry import query
from ..sources import documents, subtitles
from .views import table

C = F.col


def subtitle_files(spark, sf_dir):
    """A file for each conversation: a cue every 3 s; turns divisible by 7 have reversed times, those by 5 no timing line."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.trim("text"), r"\n+", "\n").alias("text"))
    start = C("turn") * 3000
    timing = F.concat(format_srt_timestamp(start), F.lit(" --> "), format_srt_timestamp(F.when(C("turn") % 7 == 6, start - 1).otherwise(start + 2500)), F.lit("\n"))
    block = F.concat((C("turn") + 1).cast("string"), F.lit("\n"), F.when(C("turn") % 5 == 4, F.lit("")).otherwise(timing), C("text"))
    files = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("content"))
    return files.select(F.concat(F.lit("/talks/"), C("conv_id").cast("string"), F.lit(".en.srt")).alias("path"), "content")


_CUES = "SELECT '/talks/' || CAST(conv_id AS VARCHAR) || '.en.srt' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, turn * 3000 AS start_ms, CASE WHEN turn % 7 = 6 THEN turn * 3000 + 2000 ELSE turn * 3000 + 2500 END AS end_ms FROM conversations WHERE turn % 5 <> 4 AND trim(text) <> ''"


@query(_CUES)
def s1_s3_parse_subtitles(spark, sf_dir):
    return subtitles.parse_cues(subtitle_files(spark, sf_dir)).select("path", "idx", "start_ms", "end_ms")


@query("SELECT '/talks/' || CAST(conv_id AS VARCHAR) || '.en.srt' AS path, 'srt' AS format, count(*) FILTER (WHERE turn % 5 <> 4) AS cues, count(*) FILTER (WHERE turn % 5 = 4) AS skipped FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def s2_s4_ingest_report(spark, sf_dir):
    return subtitles.ingest_report(subtitle_files(spark, sf_dir)).select("path", "format", "cues", "skipped")


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'ko' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' WHEN 3 THEN 'de' ELSE 'und' END AS language FROM pages")
def s5_language_from_filename(spark, sf_dir):
    names = F.array(*map(F.lit, ("x.ko.srt", "x.en-US.vtt", "x_FR.ass", "my-de.sbv", "x.eng.srt", "x.srt")))
    name = F.get(names, (C("page_id") % 6).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", subtitles.language_from_filename(F.concat("url", name)).alias("language"))


@query(f"WITH c AS ({_CUES}) SELECT md5('cue:' || path || ':' || CAST(idx AS VARCHAR)) AS id, start_ms, 'en' AS language, CASE WHEN idx % 2 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM c")
def s6_cues_to_evidence(spark, sf_dir):
    cues = subtitles.parse_cues(subtitle_files(spark, sf_dir))
    return subtitles.cues_to_evidence(cues, subtitles.language_from_filename(C("path")), C("idx") % 2 == 0).select("id", "start_ms", "language", "confidence")


def projects(spark, sf_dir):
    """A project for each conversation: a scene for each turn, one beat in it; some are of a newer version, some have a broken scene."""
    t = table(spark, sf_dir, "conversations")
    beat = F.struct(C("turn").cast("string").alias("id"), C("role").alias("type"), (C("turn") * 3000.0).alias("start"), "text")
    end = F.when((C("conv_id") % 11 == 0) & (C("turn") == 0), -5.0).otherwise(C("turn") * 3000.0 + 2500)
    scene = F.struct(F.concat(F.lit("s"), C("turn").cast("string")).alias("id"), (C("turn") * 3000.0).alias("start"), end.alias("end"), F.array(beat).alias("beats"))
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", scene.alias("s")))).alias("l"))
    body = F.struct(F.when(C("conv_id") % 7 == 0, 9).otherwise(2).alias("version"), F.transform("l", lambda x: x["s"]).alias("scenes"))
    return rows.select(C("conv_id").cast("string").alias("id"), F.to_json(body).alias("body"))


@query("SELECT CAST(conv_id AS VARCHAR) AS id, 's' || CAST(turn AS VARCHAR) AS scene_id, CAST(turn AS VARCHAR) AS beat_id, role AS type, turn * 3000 AS start_ms, text FROM conversations WHERE conv_id % 7 <> 0 AND NOT (conv_id % 11 = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0))")
def s7_read_projects(spark, sf_dir):
    return documents.project_tables(documents.check_projects(projects(spark, sf_dir)))[1]


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id, CASE WHEN conv_id % 7 = 0 THEN 'newer version' ELSE 'bad scene' END AS reason FROM conversations WHERE conv_id % 7 = 0 OR (conv_id % 11 = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0))")
def s7_quarantine(spark, sf_dir):
    return documents.project_tables(documents.check_projects(projects(spark, sf_dir)))[3]


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 3 THEN 3 ELSE 2 END AS INT) AS version, doc_id % 4 = 3 AS rejected, CASE WHEN doc_id % 4 < 2 THEN lang ELSE 'kept' END AS subtitles FROM documents")
def s8_migrate_documents(spark, sf_dir):
    v = F.when(C("doc_id") % 4 == 0, F.lit(None)).otherwise(C("doc_id") % 4).cast("int")
    rows = table(spark, sf_dir, "documents").select("doc_id", v.alias("version"), C("lang").alias("languages"), F.lit("kept").alias("platform_subtitles"))
    return documents.migrate(rows).select("doc_id", "version", "rejected", C("platform_subtitles").alias("subtitles"))


def _stored(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(documents.document_id("o_orderpriority", "o_custkey").alias("id"), C("o_orderdate").cast("timestamp").alias("updated_at"), "o_orderkey", "o_totalprice")


_NEWEST = "SELECT id, o_orderkey, o_totalprice FROM (SELECT o_orderpriority || ':' || CAST(o_custkey AS VARCHAR) AS id, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1"


@query(_NEWEST)
def s9_upsert_documents(spark, sf_dir):
    s = _stored(spark, sf_dir)
    return documents.upsert(s.where("o_orderkey % 2 = 0"), s.where("o_orderkey % 2 = 1"), "id", "updated_at", "o_orderkey").select("id", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def s10_get_by_content(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_custkey = 7").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def s11_list_documents(spark, sf_dir):
    return documents.newest(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def s12_delete_documents(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(C("c_custkey").alias("o_custkey"))
    return documents.delete(table(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey")


def beats(spark, sf_dir):
    """Turns of conversations as beats: dialogue of users and assistants; every fourth turn an action, every seventh a sound."""
    t = table(spark, sf_dir, "conversations")
    kind = F.when(C("turn") % 4 == 3, "action").when(C("turn") % 7 == 5, "sound").otherwise("dialogue")
    return t.select(C("conv_id").alias("title_id"), C("turn").alias("place"), kind.alias("type"), (C("turn") * 3000).alias("start_ms"), (C("turn") * 3000 + 2500).alias("end_ms"), C("role").alias("name"), F.regexp_replace(F.trim("text"), r"\s+", " ").alias("text"))


_BEATS = "b AS (SELECT conv_id AS title_id, turn AS place, CASE WHEN turn % 4 = 3 THEN 'action' WHEN turn % 7 = 5 THEN 'sound' ELSE 'dialogue' END AS type, turn * 3000 AS start_ms, role, regexp_replace(trim(text), '\\s+', ' ', 'g') AS text FROM conversations)"


@query(f"WITH {_BEATS} SELECT title_id, place, CAST(1 AS INT) AS part, CASE WHEN type = 'dialogue' THEN 'character' ELSE type END AS kind, CASE WHEN type = 'dialogue' THEN upper(role) ELSE text END AS text FROM b UNION ALL SELECT title_id, place, 2, 'dialogue', text FROM b WHERE type = 'dialogue'")
def p6_render(spark, sf_dir):
    return render.render(beats(spark, sf_dir)).select("title_id", "place", "part", "kind", "text")


def _sink(name: str, heads: str, tail: str, form: dict[str, str], line: str):
    cases = " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in form.items())
    return f"WITH {_BEATS}, l AS (SELECT title_id, place, 1 AS part, CASE WHEN type = 'dialogue' THEN 'character' ELSE type END AS kind, CASE WHEN type = 'dialogue' THEN upper(role) ELSE text END AS text FROM b UNION ALL SELECT title_id, place, 2, 'dialogue', text FROM b WHERE type = 'dialogue') SELECT title_id, md5({heads} || string_agg(CASE {cases} ELSE {line} END, chr(10) ORDER BY place, part) || {tail}) AS content FROM l GROUP BY title_id"


@query(_sink("fountain", "'Title: Untitled' || chr(10) || 'Notes: reconstructed from timed evidence' || chr(10)", "chr(10)", {"character": "chr(10) || '@' || text", "dialogue": "text"}, "chr(10) || '!' || text"))
def s14_write_fountain(spark, sf_dir):
    return render.to_fountain(render.render(beats(spark, sf_dir))).select("title_id", F.md5("content").alias("content"))


@query(_sink("markdown", "'# Untitled' || chr(10)", "chr(10)", {"character": "chr(10) || '**' || text || '**'", "dialogue": "'> ' || text"}, "chr(10) || text"))
def s15_write_markdown(spark, sf_dir):
    return render.to_markdown(render.render(beats(spark, sf_dir))).select("title_id", F.md5("content").alias("content"))


@query(
    f"WITH {_BEATS}, l AS (SELECT title_id, place, 1 AS part, CASE WHEN type = 'dialogue' THEN chr(10) || repeat(' ', 20) || upper(role) ELSE chr(10) || text END AS line FROM b UNION ALL SELECT title_id, place, 2, repeat(' ', 10) || text FROM b WHERE type = 'dialogue') "
    r"SELECT title_id, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY place, part), '^\n+', ''), '\n{3,}', chr(10) || chr(10), 'g') || chr(10) AS content FROM l GROUP BY title_id"
)
def s16_write_text(spark, sf_dir):
    return render.to_text(render.render(beats(spark, sf_dir)))


_CLOCK = "lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"


@query(f"WITH {_BEATS}, d AS (SELECT title_id, place, start_ms AS s, start_ms + 2500 AS e, text, row_number() OVER (PARTITION BY title_id ORDER BY place) AS i FROM b WHERE type = 'dialogue') SELECT title_id, string_agg(CAST(i AS VARCHAR) || chr(10) || {_CLOCK.format('s')} || ' --> ' || {_CLOCK.format('e')} || chr(10) || text || chr(10), chr(10) ORDER BY i) AS content FROM d GROUP BY title_id")
def s17_write_srt(spark, sf_dir):
    return render.to_srt(render.render(beats(spark, sf_dir)))


@query(f"""WITH {_BEATS}, s AS (SELECT title_id, CAST(place // 4 AS VARCHAR) AS id, min(start_ms) AS a, max(start_ms) + 2500 AS e, list({{'id': CAST(place AS VARCHAR), 'type': type, 'start': start_ms, 'text': text}} ORDER BY place) AS beats FROM b GROUP BY title_id, place // 4),
t AS (SELECT title_id, list({{'id': id, 'start': a, 'end': e, 'beats': beats}} ORDER BY a) AS scenes FROM s GROUP BY title_id), r AS (SELECT DISTINCT title_id, role FROM b WHERE type = 'dialogue'), c AS (SELECT title_id, list({{'name': role}} ORDER BY role) AS characters FROM r GROUP BY title_id)
SELECT t.title_id, md5(to_json({{'version': 2, 'title': CAST(t.title_id AS VARCHAR), 'scenes': scenes, 'characters': coalesce(characters, [])}})) AS content FROM t LEFT JOIN c ON c.title_id = t.title_id""")
def s18_write_json(spark, sf_dir):
    b = beats(spark, sf_dir).withColumns({"scene_id": F.floor(C("place") / 4).cast("string"), "beat_id": C("place").cast("string")})
    s = b.groupBy("title_id", "scene_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    people = b.where("type = 'dialogue'").select("title_id", "name").distinct()
    return render.to_json(s, b, characters=people).withColumn("content", F.md5("content"))


@query(f"WITH {_BEATS} SELECT title_id, count(*) * 2 AS lines FROM b WHERE type = 'dialogue' GROUP BY title_id")
def s19_dialogue_only(spark, sf_dir):
    return render.dialogue_only(render.render(beats(spark, sf_dir))).groupBy("title_id").agg(F.count("*").alias("lines"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') || CASE WHEN p_size % 2 = 0 THEN '-s' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'e' || lpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0') ELSE '-' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') END || '.en.srt' AS name FROM part")
def s20_build_filename(spark, sf_dir):
    numbered = C("p_size") % 2 == 0
    return table(spark, sf_dir, "part").select("p_partkey", render.build_filename(C("p_brand"), C("p_type"), F.when(numbered, C("p_size")), F.when(numbered, C("p_partkey") % 90), F.lit("en"), "srt").alias("name"))
