"""Scenes and beats as lines; lines as documents in several formats, a row for each title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify, to_character_cue
from ..functions.time import format_srt_timestamp

C = F.col


def render(beats: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """title_id, place, part, kind, text, start_ms, end_ms: a beat gives one line, dialogue a cue and a line; a heading opens each scene.

    beats: title_id, place, type, start_ms, end_ms, name, text; headings: title_id, start_ms, text.
    """
    line = lambda part, kind, text: F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), text.alias("text"))
    one = F.when(C("type") == "dialogue", F.array(line(1, "character", to_character_cue(F.coalesce("name", F.lit("UNKNOWN SPEAKER")))), line(2, "dialogue", C("text"))))
    for t, kind in (("action", "action"), ("sound", "sound"), ("on-screen-text", "super"), ("transition", "transition")):
        one = one.when(C("type") == t, F.array(line(1, kind, C("text"))))
    lines = beats.select("title_id", "place", "start_ms", "end_ms", F.explode(one).alias("l")).select("title_id", "place", "l.part", "l.kind", "l.text", "start_ms", "end_ms")
    if headings is not None:
        lines = lines.unionByName(headings.select("title_id", F.lit(0).alias("place"), F.lit(0).alias("part"), F.lit("heading").alias("kind"), "text", "start_ms", C("start_ms").alias("end_ms")))
    return lines


def dialogue_only(lines: DataFrame) -> DataFrame:
    return lines.where(C("kind").isin("dialogue", "character"))


def _document(lines: DataFrame, text: Column, separator: str = "\n") -> DataFrame:
    """title_id, content: the lines in order. A title's document is one value, as a file is."""
    rows = lines.select("title_id", F.struct("start_ms", "place", "part", text.alias("t")).alias("r"))
    return rows.groupBy("title_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["t"]), separator).alias("content"))


def to_fountain(lines: DataFrame, title: str = "Untitled") -> DataFrame:
    k, t = C("kind"), C("text")
    text = F.when(k == "heading", F.concat(F.lit("\n."), t)).when(k == "character", F.concat(F.lit("\n@"), t)).when(k == "dialogue", t).when(k == "transition", F.concat(F.lit("\n> "), t)).when(k == "super", F.concat(F.lit("\n[["), t, F.lit("]]"))).otherwise(F.concat(F.lit("\n!"), t))
    return _document(lines, text).withColumn("content", F.concat(F.lit(f"Title: {title}\nNotes: reconstructed from timed evidence\n"), "content", F.lit("\n")))


def to_markdown(lines: DataFrame, title: str = "Untitled") -> DataFrame:
    k, t = C("kind"), C("text")
    text = F.when(k == "heading", F.concat(F.lit("\n## "), t, F.lit("\n"))).when(k == "character", F.concat(F.lit("\n**"), t, F.lit("**"))).when(k == "dialogue", F.concat(F.lit("> "), t)).when(k == "transition", F.concat(F.lit("\n*"), t, F.lit("*"))).when(k == "super", F.concat(F.lit("\n<sub>"), t, F.lit("</sub>"))).otherwise(F.concat(F.lit("\n"), t))
    return _document(lines, text).withColumn("content", F.concat(F.lit(f"# {title}\n"), "content", F.lit("\n")))


def to_text(lines: DataFrame) -> DataFrame:
    """Indented by kind; runs of empty lines are one."""
    k, t = C("kind"), C("text")
    text = F.when(k == "character", F.concat(F.lit("\n" + " " * 20), t)).when(k == "dialogue", F.concat(F.lit(" " * 10), t)).when(k == "transition", F.concat(F.lit("\n" + " " * 50), t)).otherwise(F.concat(F.lit("\n"), t))
    return _document(lines, text).withColumn("content", F.concat(F.regexp_replace(F.regexp_replace("content", r"^\n+", ""), r"\n{3,}", "\n\n"), F.lit("\n")))


def to_srt(lines: DataFrame) -> DataFrame:
    """Dialogue, numbered; a missing end is two seconds after the start, half a second at least."""
    end = F.greatest(F.coalesce("end_ms", C("start_ms") + 2000), C("start_ms") + 500)
    rows = lines.where("kind = 'dialogue'").select("title_id", F.struct("start_ms", "place", end.alias("e"), "text").alias("r"))
    listed = rows.groupBy("title_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    cue = F.transform("r", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), format_srt_timestamp(x["start_ms"]), F.lit(" --> "), format_srt_timestamp(x["e"]), F.lit("\n"), x["text"], F.lit("\n")))
    return listed.select("title_id", F.array_join(cue, "\n").alias("content"))


def to_json(scenes: DataFrame, beats: DataFrame, **sections: DataFrame) -> DataFrame:
    """The project envelope of each title. scenes: title_id, scene_id, start_ms, end_ms; beats also scene_id, place.

    sections: further parts by name (characters, languages, coverage, conflicts, sources ...), each a table with title_id whose
    other columns are one entry; entries stand in the order of their columns, a title without any has an empty list.
    """
    b = beats.groupBy("title_id", "scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(C("beat_id").alias("id"), "type", C("start_ms").alias("start"), "text").alias("b")))), lambda x: x["b"]).alias("beats"))
    s = scenes.join(b, ["title_id", "scene_id"], "left")
    one = F.struct("start_ms", F.struct(C("scene_id").alias("id"), C("start_ms").alias("start"), C("end_ms").alias("end"), "beats").alias("s"))
    listed = s.groupBy("title_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("scenes"))
    for name, rows in sections.items():
        entry = F.struct(*[c for c in rows.columns if c != "title_id"])
        part = rows.groupBy("title_id").agg(F.array_sort(F.collect_list(entry)).alias(name))
        listed = listed.join(part.hint("merge"), "title_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return listed.select("title_id", F.to_json(F.struct(F.lit(2).alias("version"), C("title_id").cast("string").alias("title"), "scenes", *sections)).alias("content"))


def build_filename(series: Column, title: Column, season: Column, episode: Column, language: Column, extension: str) -> Column:
    """series-sNNeNN.language.ext; without numbers series-title."""
    number = F.when(season.isNotNull() & episode.isNotNull(), F.concat(F.lit("s"), F.lpad(season.cast("string"), 2, "0"), F.lit("e"), F.lpad(episode.cast("string"), 2, "0"))).when(series.isNotNull() & title.isNotNull(), slugify(title, 40))
    return F.concat(F.concat_ws("-", slugify(F.coalesce(series, title, F.lit("untitled"))), number), F.lit("."), slugify(language, 12), F.lit("." + extension))


def write_documents(documents: DataFrame, path: str) -> None:
    """One text file or more for each title, under title_id=..."""
    documents.select("title_id", C("content").alias("value")).write.partitionBy("title_id").text(path)
