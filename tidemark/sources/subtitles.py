"""SRT and WebVTT files as tables, without Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_lines
from ..functions.time import parse_timestamp

C = F.col
# Fixed value: the form of a time in both formats.
STAMP = r"(?:[0-9]{1,3}:)?[0-9]{1,2}:[0-9]{1,2}[,.][0-9]{1,3}"
TIMING = rf"^\s*{STAMP}\s*-->\s*{STAMP}"


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file under a path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), C("value").alias("content"))


def detect_format(content: Column) -> Column:
    """vtt or srt by the first lines of the file, not by its name; else unknown. A cue begins with its times, or with its number and then a time."""
    lines = F.filter(F.split(F.regexp_replace(content, r"^\x{FEFF}", ""), r"\r\n?|\n"), lambda x: F.trim(x) != "")
    first, second = F.ltrim(F.get(lines, 0)), F.ltrim(F.get(lines, 1))
    cue = first.rlike(TIMING) | (first.rlike(r"^[0-9]+\s*$") & second.rlike(r"^[0-9]{1,3}:[0-9]{2}"))
    return F.when(F.upper(first).startswith("WEBVTT"), "vtt").when(cue, "srt").otherwise("unknown")


def language_from_filename(path: Column) -> Column:
    """``x.ko.srt``, ``x_ko.vtt`` and ``x-ko-KR.srt`` are ko, else und: two letters behind a sign, with or without a region, before a caption file's ending."""
    stem = F.regexp_extract(path, r"(?i)^(.*)\.(?:srt|vtt|sbv|ass|ssa)$", 1)
    tag = F.regexp_extract(stem, r"(?i)[._-]([a-z]{2})(?:[_-][a-z]{2,4})?$", 1)
    return F.when(tag != "", F.lower(tag)).otherwise("und")


def blocks(files: DataFrame) -> DataFrame:
    """path, block (number), lines, timing (number of the timing line, null without one) of every block that is not a header or a note.

    Empty lines part blocks; a line that begins a note, a style or a region ends what is read of its block.
    """
    text = F.regexp_replace(F.regexp_replace("content", r"^\x{FEFF}", ""), r"\r\n?", "\n")
    b = files.select("path", F.posexplode(F.split(text, r"\n{2,}")).alias("block", "body")).select("path", "block", F.split("body", "\n").alias("all"))
    first = lambda test: F.array_min(F.filter(F.transform("all", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()))
    note = first(lambda x: F.regexp_extract(x, "^[A-Z]+", 0).rlike("^(NOTE|STYLE|REGION)"))
    read = F.when(note.isNull(), C("all")).when(note > 0, F.slice("all", 1, note)).otherwise(F.array().cast("array<string>"))
    b = b.select("path", "block", F.filter(read, lambda x: F.trim(x) != "").alias("all")).where((F.size("all") > 0) & ~F.upper(F.get("all", 0)).startswith("WEBVTT"))
    return b.withColumn("timing", first(lambda x: x.rlike(TIMING))).withColumnRenamed("all", "lines")


def parsed_blocks(files: DataFrame) -> DataFrame:
    """blocks with start_ms, end_ms, text, clean lines; ok where a cue can be read."""
    b = blocks(files)
    line = F.get("lines", C("timing"))
    left, right = F.element_at(F.split(line, "-->"), 1), F.get(F.split(line, "-->"), 1)
    clean = normalized_lines(F.array_join(F.slice("lines", C("timing") + 2, F.size("lines")), "\n"))
    b = b.select("path", "block", "timing", parse_timestamp(left).alias("start_ms"), parse_timestamp(right).alias("stop"), F.when(C("timing").isNotNull(), clean).alias("lines"))
    ok = C("timing").isNotNull() & C("start_ms").isNotNull() & C("stop").isNotNull() & (F.coalesce(F.size("lines"), F.lit(0)) > 0)
    return b.withColumns({"ok": ok, "reversed": ok & (C("stop") <= C("start_ms")), "end_ms": F.when(C("stop") > C("start_ms"), C("stop")).otherwise(C("start_ms") + 2000), "text": F.array_join("lines", " ")})


def parse_cues(files: DataFrame) -> DataFrame:
    """path, idx, start_ms, end_ms, text, lines in media order; ends at or before the start become two seconds."""
    good = parsed_blocks(files).where("ok")
    idx = F.row_number().over(Window.partitionBy("path").orderBy("block"))
    return good.select("path", idx.alias("idx"), "start_ms", "end_ms", "text", "lines")


def ingest_report(files: DataFrame) -> DataFrame:
    """path, format, cues, skipped, warnings of each file; a file of nothing has a row too."""
    b = parsed_blocks(files).groupBy("path").agg(F.count_if("ok").alias("cues"), F.count_if(~C("ok")).alias("skipped"), F.count_if("reversed").alias("reversed"))
    r = files.select("path", detect_format(C("content")).alias("format")).join(b.hint("merge"), "path", "left").na.fill(0, ["cues", "skipped", "reversed"])
    said = F.array_compact(F.array(
        F.when(C("reversed") > 0, F.concat(C("reversed").cast("string"), F.lit(" cues end before they start"))),
        F.when((C("cues") == 0) & (C("skipped") > 0), F.lit("no cue could be read")),
        F.when(C("skipped") > 0, F.concat(C("skipped").cast("string"), F.lit(" blocks skipped"))),
    ))
    return r.select("path", "format", "cues", "skipped", said.alias("warnings"))


def cues_to_evidence(cues: DataFrame, language: Column, auto_generated: Column) -> DataFrame:
    return cues.select(F.md5(F.concat_ws(":", F.lit("cue"), "path", "idx")).alias("id"), "path", F.lit("subtitle").alias("source"), "start_ms", "end_ms", "text", language.alias("language"), F.when(auto_generated, "medium").otherwise("high").alias("confidence"), auto_generated.alias("auto_generated"))
