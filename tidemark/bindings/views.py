"""Views of the given tables that operators work on, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.confidence import from_score

EPOCH_MS = 1704067200000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence: 20 titles, a source each, start and end in media milliseconds, an ordinal confidence."""
    return evidence_of(table(spark, sf_dir, "events"))


def evidence_of(events: DataFrame) -> DataFrame:
    """That view of a table or a stream of events."""
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long") - EPOCH_MS
    return events.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("title_id"), "user_id", F.col("event_type").alias("source"),
        start.alias("start_ms"), (start + F.floor(F.col("value") * 60000).cast("long")).alias("end_ms"), "value", "props",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        from_score(F.col("value") / 100, F.col("event_type") == "purchase").alias("confidence"),
    )


SCORE = "CASE WHEN value / 100 >= 0.75 THEN 3 WHEN value / 100 >= 0.45 THEN 2 WHEN value / 100 > 0 THEN 1 ELSE 0 END"
#: The same view as a common table expression; rank is the confidence's ordinal.
EV = f"""ev AS (SELECT event_id AS seq, user_id % 20 AS title_id, user_id, event_type AS source,
  epoch_us(ts) // 1000 - {EPOCH_MS} AS start_ms, epoch_us(ts) // 1000 - {EPOCH_MS} + CAST(floor(value * 60000) AS BIGINT) AS end_ms, value, props,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_type = 'purchase' THEN {SCORE} ELSE least(2, {SCORE}) END AS rank FROM events)"""
WITH = f"WITH {EV}"
LEVEL = "CASE {} WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'unknown' END"


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with the sources and kinds of a title: pictures, on-screen text, chapters, seeks, captions."""
    e = evidence(spark, sf_dir)
    s, k = F.col("source"), F.col("k")
    source = F.when(s == "click", "video").when(s == "error", "ocr").when(s == "purchase", "metadata").when(s == "signup", "playback").otherwise("subtitle")
    kind = (
        F.when(s == "click", F.when(k % 3 == 0, "scene-change").when(k % 3 == 1, "setting").otherwise("action"))
        .when(s == "purchase", F.when(k % 5 == 0, "chapter").otherwise("title")).when(s == "signup", F.when(k % 2 == 0, "seek").otherwise("play"))
    )
    return e.select("title_id", "seq", "user_id", source.alias("source"), kind.alias("kind"), "start_ms", "end_ms", (F.col("value") / 100).alias("cut"), F.lit(False).alias("significant"), F.lit(0).alias("duration_ms"), "k", "value", "confidence")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 luma grids, a title for each label, a frame every 500 ms."""
    luma = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    t = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("title_id"), F.col("vec_id").alias("seq"), (F.col("vec_id") * 500).alias("at_ms"), luma.alias("luma"))
    at = F.transform("luma", lambda v: F.least(F.lit(31), F.floor(v / 8)))
    hist = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.size(F.filter("at", lambda x: x == b)) / 64)
    mean = F.aggregate("luma", F.lit(0.0), lambda s, x: s + x) / (64 * 255)
    return t.withColumn("at", at).select("title_id", "seq", "at_ms", "luma", hist.alias("histogram"), mean.alias("mean"))


MEDIA = f"""{EV}, media AS (SELECT title_id, seq, user_id, k, value, rank, start_ms, end_ms, value / 100 AS cut,
  CASE source WHEN 'click' THEN 'video' WHEN 'error' THEN 'ocr' WHEN 'purchase' THEN 'metadata' WHEN 'signup' THEN 'playback' ELSE 'subtitle' END AS source,
  CASE WHEN source = 'click' THEN CASE k % 3 WHEN 0 THEN 'scene-change' WHEN 1 THEN 'setting' ELSE 'action' END WHEN source = 'purchase' THEN CASE WHEN k % 5 = 0 THEN 'chapter' ELSE 'title' END
  WHEN source = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'seek' ELSE 'play' END END AS kind FROM ev)"""
