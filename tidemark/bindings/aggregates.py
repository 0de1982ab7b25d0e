"""Aggregations of the events, orders and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..operators import aggregates, intervals
from ..registry import query
from .intervals import _islands
from .views import EV, LEVEL, WITH, evidence, table

C = F.col


@query(f"{WITH} SELECT title_id, k, {LEVEL.format('least(3, max(rank) + CASE WHEN count(DISTINCT source) >= 2 THEN 1 ELSE 0 END)')} AS confidence FROM ev GROUP BY title_id, k")
def a5_corroborate(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("title_id", "k").agg(conf.corroborate(C("confidence"), C("source")).alias("confidence"))


@query(f"{WITH} SELECT title_id, k, {LEVEL.format('min(rank)')} AS least, {LEVEL.format('max(rank)')} AS most FROM ev GROUP BY title_id, k")
def a6_min_max_confidence(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("title_id", "k").agg(conf.min_confidence(C("confidence")).alias("least"), conf.max_confidence(C("confidence")).alias("most"))


_PROV = f"""{WITH}, f AS (SELECT title_id, k, source, min(start_ms * 1000000 + seq) AS pos FROM ev GROUP BY title_id, k, source),
s AS (SELECT title_id, k, string_agg(source, ',' ORDER BY pos) AS sources FROM f GROUP BY title_id, k),
i AS (SELECT title_id, k, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY start_ms, seq) AS ids, {LEVEL.format('least(3, max(rank) + CASE WHEN count(DISTINCT source) >= 2 THEN 1 ELSE 0 END)')} AS confidence, max(CASE WHEN source = 'view' THEN 1 ELSE 0 END) = 1 AS inferred FROM ev GROUP BY title_id, k)"""


def _provenance(spark, sf_dir, *by):
    return aggregates.provenance_from(evidence(spark, sf_dir).withColumn("inferred", C("source") == "view"), *by)


@query(f"{_PROV} SELECT i.title_id, i.k, ids, sources, confidence, inferred FROM i JOIN s ON i.title_id = s.title_id AND i.k = s.k")
def a7_provenance_from(spark, sf_dir):
    p = _provenance(spark, sf_dir, "title_id", "k")
    return p.select("title_id", "k", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join("sources", ",").alias("sources"), "confidence", "inferred")


@query(f"""{WITH}, p AS (SELECT title_id, k, least(3, max(rank) + CASE WHEN count(DISTINCT source) >= 2 THEN 1 ELSE 0 END) AS c FROM ev GROUP BY title_id, k),
m AS (SELECT title_id, min(c) AS c FROM p GROUP BY title_id) SELECT title_id, count(DISTINCT seq) AS ids, count(DISTINCT source) AS sources, {LEVEL.format('max(m.c)')} AS confidence, max(CASE WHEN source = 'view' THEN 1 ELSE 0 END) = 1 AS inferred FROM ev JOIN m USING (title_id) GROUP BY title_id""")
def a8_merge_provenance(spark, sf_dir):
    m = aggregates.merge_provenance(_provenance(spark, sf_dir, "title_id", "k"), "title_id")
    return m.select("title_id", F.size("evidence_ids").cast("long").alias("ids"), F.size("sources").cast("long").alias("sources"), "confidence", "inferred")


@query(f"{WITH} SELECT title_id, source, 'active' AS state, count(*) AS event_count, arg_max(start_ms, seq) AS last_event_at FROM ev GROUP BY title_id, source")
def a9_source_status(spark, sf_dir):
    return aggregates.source_status(evidence(spark, sf_dir))


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(f"{WITH} SELECT title_id, " + ", ".join(f"count(*) FILTER (WHERE source = '{k}') AS \"{k}\"" for k in _KINDS) + " FROM ev GROUP BY title_id")
def a10_summarize_beats(spark, sf_dir):
    return aggregates.count_kinds(evidence(spark, sf_dir), "title_id", "source", _KINDS)


@query("WITH f AS (SELECT source, lang, min(doc_id) AS pos FROM documents WHERE lang <> 'und' GROUP BY source, lang) SELECT source, string_agg(lang, ',' ORDER BY pos) AS languages FROM f GROUP BY source")
def a11_collect_languages(spark, sf_dir):
    first = table(spark, sf_dir, "documents").where("lang <> 'und'").groupBy("source", "lang").agg(F.min("doc_id").alias("at"))
    return first.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "lang"))), lambda x: x["lang"]), ",").alias("languages"))


@query(f"{WITH} SELECT title_id, user_id, count(*) AS lines, min(start_ms) AS first_ms, max(start_ms) AS last_ms, CASE WHEN count(*) > 1 THEN 'high' ELSE 'medium' END AS confidence FROM ev WHERE source = 'view' GROUP BY title_id, user_id")
def a12_a13_presence_and_stats(spark, sf_dir):
    e = evidence(spark, sf_dir).where("source = 'view'")
    return e.groupBy("title_id", "user_id").agg(F.count("*").alias("lines"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"), F.when(F.count("*") > 1, "high").otherwise("medium").alias("confidence"))


@query(f"{WITH} SELECT title_id, seq, {LEVEL.format('least(2, rank)')} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY rank DESC, start_ms, seq) AS n FROM ev) WHERE n = 1")
def a14_derive_setting(spark, sf_dir):
    return aggregates.derive_setting(evidence(spark, sf_dir)).select("title_id", "seq", "confidence")


@query(f"WITH {EV}, {_islands(0)}, g AS (SELECT title_id, start_ms - lag(end_ms) OVER (PARTITION BY title_id ORDER BY start_ms) AS gap FROM merged) SELECT title_id, median(gap) AS median_ms FROM g WHERE gap IS NOT NULL GROUP BY title_id")
def a15_median_gap(spark, sf_dir):
    return aggregates.median_gap(aggregates.speech_gaps(intervals.merge_ranges(evidence(spark, sf_dir))))


@query("SELECT o_custkey, count(*) AS scenes, count(DISTINCT o_orderpriority) AS languages, round(least(1.0, sum(o_totalprice) / 1000000), 9) AS coverage FROM orders GROUP BY o_custkey")
def a16_document_summary(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("scenes"), F.count_distinct("o_orderpriority").alias("languages"), F.round(F.least(F.lit(1.0), F.sum("o_totalprice") / 1000000), 9).alias("coverage"))


@query("SELECT source, CAST(count(DISTINCT CASE WHEN doc_id % 3 = 0 THEN lang END) AS BIGINT) AS platform, CAST(count(DISTINCT CASE WHEN doc_id % 3 = 1 THEN lang END) AS BIGINT) AS transcribed, CAST(count(DISTINCT CASE WHEN doc_id % 3 = 2 THEN lang END) AS BIGINT) AS translated FROM documents GROUP BY source")
def a17_language_index(spark, sf_dir):
    of = lambda n: F.size(F.collect_set(F.when(C("doc_id") % 3 == n, C("lang")))).cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(of(0).alias("platform"), of(1).alias("transcribed"), of(2).alias("translated"))


@query(f"{WITH} SELECT title_id, source, count(*) AS events, {LEVEL.format('max(rank)')} AS best, max(CASE WHEN k < 50 THEN 1 ELSE 0 END) = 1 AS inferred FROM ev GROUP BY ROLLUP (title_id, source)")
def a18_inspector_rollup(spark, sf_dir):
    return evidence(spark, sf_dir).rollup("title_id", "source").agg(F.count("*").alias("events"), conf.max_confidence(C("confidence")).alias("best"), F.bool_or(C("k") < 50).alias("inferred"))


@query(f"{WITH} SELECT title_id, count(*) AS observations, count(*) FILTER (WHERE value >= 8) AS emitted, count(*) FILTER (WHERE value < 8) AS redundant, count(*) FILTER (WHERE source = 'purchase') AS cuts, count(*) FILTER (WHERE value < 1) AS blanks, (count(*) - 1) / ((max(start_ms) - min(start_ms)) / 1000.0) AS fps FROM ev GROUP BY title_id")
def a19_scanner_stats(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("title_id").agg(F.count("*").alias("observations"), F.count_if(C("value") >= 8).alias("emitted"), F.count_if(C("value") < 8).alias("redundant"), F.count_if(C("source") == "purchase").alias("cuts"), F.count_if(C("value") < 1).alias("blanks"), ((F.count("*") - 1) / ((F.max("start_ms") - F.min("start_ms")) / 1000)).alias("fps"))


@query(f"""{WITH}, d AS (SELECT title_id, seq, start_ms // 100000 AS at_ms FROM ev), s AS (SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY title_id ORDER BY at_ms, seq) AS step FROM d),
l AS (SELECT title_id, step, row_number() OVER (PARTITION BY title_id ORDER BY at_ms DESC, seq DESC) AS n FROM s WHERE step > 0 AND step < 500),
o AS (SELECT title_id, step, row_number() OVER (PARTITION BY title_id ORDER BY step) AS r, count(*) OVER (PARTITION BY title_id) AS c FROM l WHERE n <= 60)
SELECT title_id, floor(100000.0 / step + 0.5) / 100 AS fps FROM o WHERE r = c // 2 + 1 AND c >= 5""")
def a20_frame_rate(spark, sf_dir):
    frames = evidence(spark, sf_dir).select("title_id", "seq", F.floor(C("start_ms") / 100000).alias("at_ms"))
    return aggregates.frame_rate(frames).where("fps is not null")


@query(f"""{WITH} SELECT title_id, CASE WHEN count(*) FILTER (WHERE source = 'error' AND value > 300) > 0 THEN 'failed' WHEN count(*) FILTER (WHERE source = 'view') = 0 THEN 'nothing' WHEN count(*) FILTER (WHERE source = 'error') > 0 THEN 'partial' ELSE 'complete' END AS decode, count(DISTINCT k) AS codes FROM ev GROUP BY title_id""")
def a21_run_diagnostics(spark, sf_dir):
    errors, views = F.count_if(C("source") == "error"), F.count_if(C("source") == "view")
    state = F.when(F.count_if((C("source") == "error") & (C("value") > 300)) > 0, "failed").when(views == 0, "nothing").when(errors > 0, "partial").otherwise("complete")
    return evidence(spark, sf_dir).groupBy("title_id").agg(state.alias("decode"), F.count_distinct("k").alias("codes"))


@query(f"""{WITH}, d AS (SELECT seq, (start_ms - lag(start_ms) OVER w) / 60000.0 AS minutes, k - lag(k) OVER w AS change FROM ev WINDOW w AS (PARTITION BY title_id ORDER BY start_ms, seq))
SELECT seq, CASE WHEN minutes > 0 THEN CAST(floor(change / minutes + 0.5) AS BIGINT) END AS per_minute FROM d""")
def a22_rate_between(spark, sf_dir):
    s = evidence(spark, sf_dir).select("title_id", "seq", C("start_ms").alias("at_ms"), C("k").alias("total"))
    return aggregates.rate_between(s).select("seq", "per_minute")


@query("""WITH v AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings), b AS (SELECT vec_id, CAST(x AS DOUBLE) AS x, least(31, greatest(0, CAST(floor((CAST(x AS DOUBLE) + 1.0) * 16.0) AS INT))) AS bin FROM v)
SELECT vec_id, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, CAST(max(c) AS DOUBLE) / 64 AS peak FROM (SELECT *, count(*) OVER (PARTITION BY vec_id, bin) AS c FROM b) GROUP BY vec_id""")
def a23_histogram(spark, sf_dir):
    h = aggregates.histogram(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", low=-1.0, high=1.0)
    return h.select("vec_id", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.array_max("histogram").alias("peak"))


@query(f"""{WITH} SELECT title_id, count(*) AS attempted, count(*) FILTER (WHERE rank > 0) AS succeeded, count(*) FILTER (WHERE source = 'error') AS failed,
CAST(count(*) AS VARCHAR) || ' attempted, ' || CAST(count(*) FILTER (WHERE source = 'error') AS VARCHAR) || ' failed' AS summary FROM ev GROUP BY title_id""")
def a24_request_tallies(spark, sf_dir):
    n, bad = F.count("*"), F.count_if(C("source") == "error")
    return evidence(spark, sf_dir).groupBy("title_id").agg(n.alias("attempted"), F.count_if(C("confidence") != "unknown").alias("succeeded"), bad.alias("failed"), F.concat(n.cast("string"), F.lit(" attempted, "), bad.cast("string"), F.lit(" failed")).alias("summary"))


@query(f"{WITH} SELECT title_id, k, seq FROM (SELECT *, row_number() OVER (PARTITION BY title_id, k ORDER BY start_ms, seq) AS n FROM ev) WHERE n = 1")
def a25_notice_dedupe(spark, sf_dir):
    return aggregates.first_by(evidence(spark, sf_dir).select("title_id", "k", "start_ms", "seq"), ["title_id", "k"], "start_ms", "seq").select("title_id", "k", "seq")


@query("SELECT o_orderstatus AS status, count(*) AS scenes, CAST(sum(n) AS BIGINT) AS beats FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def a26_scene_counts(spark, sf_dir):
    beats = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("l_orderkey"), C("o_orderstatus").alias("status"))
    return o.join(beats, "l_orderkey").groupBy("status").agg(F.count("*").alias("scenes"), F.sum("n").alias("beats"))


# --- order, rank and set operators


@query(f"{WITH} SELECT seq, row_number() OVER (PARTITION BY title_id ORDER BY start_ms, source, seq) AS place FROM ev")
def k1_timeline_order(spark, sf_dir):
    return evidence(spark, sf_dir).select("seq", F.row_number().over(Window.partitionBy("title_id").orderBy("start_ms", "source", "seq")).alias("place"))


_VARIANTS = """v AS (SELECT p_partkey % 100 AS title_id, p_partkey AS option_id, CASE WHEN p_size % 11 <> 0 THEN 360 * (1 + p_size % 6) END AS resolution, p_size % 4 = 0 AS enhanced, p_size % 5 = 0 AS hdr,
CASE p_size % 3 WHEN 0 THEN 24 WHEN 1 THEN 60 END AS frame_rate, p_name AS label, p_partkey % 7 <> 0 AS selectable, p_partkey % 13 = 0 AS auto FROM part)"""
_RANK = "row_number() OVER (PARTITION BY title_id ORDER BY coalesce(resolution, -1) DESC, CASE WHEN enhanced THEN 0 ELSE 1 END, CASE WHEN hdr THEN 0 ELSE 1 END, coalesce(frame_rate, 0) DESC, label, option_id)"


def variants(spark, sf_dir):
    size = C("p_size")
    return table(spark, sf_dir, "part").select(
        (C("p_partkey") % 100).alias("title_id"), C("p_partkey").alias("option_id"), F.when(size % 11 != 0, 360 * (1 + size % 6)).alias("resolution"), (size % 4 == 0).alias("enhanced"),
        (size % 5 == 0).alias("hdr"), F.when(size % 3 == 0, 24).when(size % 3 == 1, 60).alias("frame_rate"), C("p_name").alias("label"), (C("p_partkey") % 7 != 0).alias("selectable"), (C("p_partkey") % 13 == 0).alias("auto"),
    )


@query(f"WITH {_VARIANTS} SELECT title_id, option_id, {_RANK} AS rank FROM v WHERE selectable AND NOT auto")
def k2_rank_variants(spark, sf_dir):
    from ..operators.ranking import rank_variants

    return rank_variants(variants(spark, sf_dir)).select("title_id", "option_id", "rank")


@query(f"""WITH {_VARIANTS}, r AS (SELECT *, {_RANK} AS n FROM v WHERE selectable AND NOT auto), c AS (SELECT DISTINCT title_id, 720 + 360 * (title_id % 4) AS ceiling, title_id % 2 = 0 AS likes FROM v),
e AS (SELECT r.*, ceiling, likes, resolution IS NOT NULL AND resolution <= ceiling AS fits FROM r JOIN c USING (title_id)),
t AS (SELECT title_id, max(ceiling) AS ceiling, max(CASE WHEN likes THEN 1 ELSE 0 END) = 1 AS likes, arg_min(option_id, n) FILTER (WHERE fits) AS top, arg_min(resolution, n) FILTER (WHERE fits) AS res, arg_max(option_id, n) AS low, arg_min(resolution, n) AS first_res, max(resolution) AS most FROM e GROUP BY title_id),
s AS (SELECT e.title_id, arg_min(option_id, n) AS std FROM e JOIN t USING (title_id) WHERE fits AND e.resolution = t.res AND NOT enhanced GROUP BY e.title_id),
b AS (SELECT v.title_id FROM v JOIN t USING (title_id) WHERE NOT selectable AND NOT auto AND v.resolution > t.res AND v.resolution <= t.ceiling GROUP BY v.title_id)
SELECT title_id, CASE WHEN top IS NULL THEN low WHEN likes THEN top ELSE coalesce(std, top) END AS option_id,
CASE WHEN top IS NULL THEN 'availability' WHEN b.title_id IS NOT NULL THEN 'entitlement' WHEN most > ceiling THEN 'preference' WHEN first_res < ceiling THEN 'availability' END AS limited_by FROM t LEFT JOIN s USING (title_id) LEFT JOIN b USING (title_id)""")
def k3_select_variant(spark, sf_dir):
    from ..operators.ranking import select_variant

    v = variants(spark, sf_dir)
    wish = v.select("title_id").distinct().select("title_id", (720 + 360 * (C("title_id") % 4)).alias("ceiling"), (C("title_id") % 2 == 0).alias("prefer_enhanced"))
    return select_variant(v, wish).select("title_id", "option_id", "limited_by")


@query(f"WITH {_VARIANTS}, a AS (SELECT title_id, max(resolution) AS resolution FROM v WHERE selectable AND NOT auto GROUP BY title_id) SELECT v.title_id, option_id, coalesce(v.resolution = a.resolution AND NOT enhanced, false) AS applied FROM v JOIN a USING (title_id)")
def k4_verify_applied(spark, sf_dir):
    from ..operators.ranking import verify_applied

    v = variants(spark, sf_dir)
    wanted = v.where("selectable and not auto").groupBy("title_id").agg(F.max("resolution").alias("want_resolution"), F.lit(False).alias("want_enhanced"), F.lit(-1).cast("long").alias("want_id"))
    return verify_applied(v, wanted).select("title_id", "option_id", "applied")


@query(f"{WITH} SELECT title_id, seq, n FROM (SELECT title_id, seq, row_number() OVER (PARTITION BY title_id ORDER BY end_ms - start_ms DESC, seq) AS n FROM ev) WHERE n <= 12")
def k6_top_n(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("title_id").orderBy((C("end_ms") - C("start_ms")).desc(), "seq"))
    return evidence(spark, sf_dir).withColumn("n", n).where("n <= 12").select("title_id", "seq", "n")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'unsupported' WHEN p_size % 5 = 1 THEN 'actual-resolution-unknown' WHEN p_size % 5 = 2 THEN 'best-effort-active' ELSE 'optimizing' END AS state FROM part")
def k7_state_classification(spark, sf_dir):
    from ..operators.ranking import playback_state

    s = C("p_size") % 5
    return table(spark, sf_dir, "part").select("p_partkey", playback_state(s != 0, F.when(s == 1, F.lit(None)).otherwise(C("p_size")).cast("int"), s == 2).alias("state"))


@query(f"{WITH} SELECT 'event' AS origin, count(*) AS n, CAST(sum(seq) AS BIGINT) AS total FROM ev UNION ALL SELECT 'conversation', count(*), CAST(sum(turn) AS BIGINT) FROM conversations")
def u1_u2_union(spark, sf_dir):
    a = evidence(spark, sf_dir).select(F.lit("event").alias("origin"), "seq", "title_id")
    b = table(spark, sf_dir, "conversations").select(F.lit("conversation").alias("origin"), C("turn").alias("seq"), "role")
    return a.unionByName(b, allowMissingColumns=True).groupBy("origin").agg(F.count("*").alias("n"), F.sum("seq").alias("total"))


@query(f"{WITH} SELECT title_id, k FROM ev WHERE source = 'view' UNION SELECT title_id, k FROM ev WHERE source = 'click'")
def u3_distinct_union(spark, sf_dir):
    e = evidence(spark, sf_dir)
    return e.where("source = 'view'").select("title_id", "k").union(e.where("source = 'click'").select("title_id", "k")).distinct()
