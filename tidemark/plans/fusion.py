"""Fusion of captions and transcripts into dialogue; attribution of speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.confidence import confidence_rank, from_rank
from ..functions.text import comparable_text, is_non_speech, speaker_label, text_similarity
from ..functions.time import iou
from ..operators.folds import Alternate, GroupCues, ordered_fold
from ..operators.intervals import overlap_join
from ..operators.joins import suppress_near
from ..operators.settle import settle

C = F.col


def attribute(beats: DataFrame, user_first: bool = False) -> DataFrame:
    """title_id, seq, character_id, attribution, confidence.

    beats: title_id, seq, at_ms, label, assigned, diarized, visual, sure, present. A label wins over a user's
    assignment (unless ``user_first``), that over diarization; what is left may alternate between two present.
    """
    steps = [("label", "label", F.lit("high")), ("assigned", "user", F.lit("high"))]
    if user_first:
        steps.reverse()
    steps.append(("diarized", "diarization", F.when(C("visual"), "high").when(C("sure"), "medium").otherwise("low")))
    known = F.coalesce(*[C(c) for c, _, _ in steps])
    ladder, sure = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, how, level in reversed(steps):
        ladder, sure = F.when(C(c).isNotNull(), how).otherwise(ladder), F.when(C(c).isNotNull(), level).otherwise(sure)
    rows = beats.select("title_id", "seq", "at_ms", known.alias("known"), ladder.alias("ladder"), sure.alias("confidence"), "present")
    return ordered_fold(rows, ["title_id"], ["at_ms", "seq"], Alternate, "title_id long, seq long, character_id string, attribution string, confidence string")


def match_transcripts(cues: DataFrame, asr: DataFrame, bucket_ms: int, least_iou: float = 0.25, least_similarity: float = 0.6) -> DataFrame:
    """(seq, asr_seq, iou, similarity): pairs that overlap and say the same. cues and asr: title_id, seq, start_ms, end_ms, text."""
    right = asr.select("title_id", C("seq").alias("r_seq"), C("start_ms").alias("r_start"), C("end_ms").alias("r_end"), comparable_text(C("text")).alias("r_text"))
    pairs = overlap_join(cues.withColumn("l_text", comparable_text(C("text"))), right, bucket_ms)
    near = pairs.withColumn("iou", iou(C("start_ms"), C("end_ms"), C("r_start"), C("r_end"))).where(C("iou") >= least_iou)
    return near.withColumn("similarity", text_similarity(C("l_text"), C("r_text"))).where(C("similarity") >= least_similarity).select("seq", C("r_seq").alias("asr_seq"), "iou", "similarity")


def conflicts(cues: DataFrame, asr: DataFrame, matches: DataFrame, bucket_ms: int, least_iou: float = 0.25) -> DataFrame:
    """(asr_seq, seq): transcripts without a match that overlap a cue which says something else; the first such cue."""
    free = asr.join(matches.select(C("asr_seq").alias("seq")).distinct().hint("merge"), "seq", "left_anti")
    right = cues.select("title_id", C("seq").alias("r_seq"), C("start_ms").alias("r_start"), C("end_ms").alias("r_end"))
    hits = overlap_join(free, right, bucket_ms).where(iou(C("start_ms"), C("end_ms"), C("r_start"), C("r_end")) > least_iou)
    return hits.groupBy(C("seq").alias("asr_seq")).agg(F.min_by("r_seq", F.struct("r_start", "r_seq")).alias("seq"))


def recovered(asr: DataFrame, matches: DataFrame, conflict: DataFrame) -> DataFrame:
    """Transcripts that no cue matches or contradicts: lines of their own."""
    used = matches.select(C("asr_seq").alias("seq")).unionByName(conflict.select(C("asr_seq").alias("seq"))).distinct()
    return asr.join(used.hint("merge"), "seq", "left_anti")


def fuse_dialogue(cues: DataFrame, asr: DataFrame, bucket_ms: int, onset_ms: int = 1500) -> tuple[DataFrame, DataFrame]:
    """Dialogue beats and conflicts.

    Cues of all languages are grouped; the first cue of a group is matched with transcripts, which may move its
    onset later by less than ``onset_ms`` and make it surer; a label names the speaker; transcripts alone are beats too.
    A missing end is two seconds after the start. Of two cues of a group in one language the later gives the variant.
    beats: title_id, beat_id, start_ms, end_ms, speaker, text, variants, sources, confidence, evidence_ids.
    """
    ended = F.coalesce("end_ms", C("start_ms") + 2000)
    cues, asr = cues.withColumn("end_ms", ended), asr.withColumn("end_ms", ended)
    # groups and matches are read by several branches, so each is written once
    grouped = settle(ordered_fold(cues.select("title_id", "seq", "start_ms", "end_ms", "language"), ["title_id"], ["start_ms", "seq"], GroupCues, "title_id long, group long, start_ms long, end_ms long, languages array<string>, cues array<long>"), "cue-groups")
    first = grouped.select("title_id", "group", "start_ms", "end_ms", "cues", F.get("cues", 0).alias("seq"))
    texts = grouped.select("title_id", "group", F.posexplode("cues").alias("i", "seq")).join(cues.select("seq", "language", "text", "confidence").hint("merge"), "seq")
    speaker, rest = speaker_label(C("text"))
    lines = texts.withColumns({"speaker": speaker, "said": rest})
    variants = lines.groupBy("title_id", "group").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("i", "language", "said"))), F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != F.coalesce(x["language"], F.lit("und"))), F.create_map(F.coalesce(x["language"], F.lit("und")), x["said"]))).alias("variants"),
        F.min_by("speaker", F.when(C("speaker").isNotNull(), C("i"))).alias("speaker"), F.min_by("said", "i").alias("text"), F.max(confidence_rank(C("confidence"))).alias("rank"),
    )
    base = first.join(cues.select("seq", "text").hint("merge"), "seq").select("title_id", "seq", "start_ms", "end_ms", "text")
    matches = settle(match_transcripts(base, asr, bucket_ms), "transcript-matches")
    heard = matches.join(asr.select(C("seq").alias("asr_seq"), C("start_ms").alias("asr_start")).hint("merge"), "asr_seq").groupBy("seq").agg(F.min("asr_start").alias("onset"), F.array_sort(F.collect_list("asr_seq")).alias("asr_ids"))
    both = first.join(variants.hint("merge"), ["title_id", "group"]).join(heard.hint("merge"), "seq", "left")
    start = F.when((C("onset") > C("start_ms")) & (C("onset") - C("start_ms") < onset_ms), C("onset")).otherwise(C("start_ms"))
    ids = F.concat("cues", F.coalesce("asr_ids", F.array().cast("array<long>")))
    beats = both.select(
        "title_id", start.alias("start_ms"), "end_ms", "speaker", "text", "variants", F.when(C("onset").isNotNull(), F.array(F.lit("subtitle"), F.lit("audio-asr"))).otherwise(F.array(F.lit("subtitle"))).alias("sources"),
        from_rank(F.least(F.lit(3), C("rank") + C("onset").isNotNull().cast("int"))).alias("confidence"), ids.alias("evidence_ids"),
    )
    clash = conflicts(cues, asr, matches, bucket_ms)
    own = recovered(asr, matches, clash).select("title_id", "start_ms", "end_ms", F.lit(None).cast("string").alias("speaker"), "text", F.create_map(F.coalesce("language", F.lit("und")), "text").alias("variants"), F.array(F.lit("audio-asr")).alias("sources"), "confidence", F.array("seq").alias("evidence_ids"))
    out = beats.unionByName(own)
    return out.withColumn("beat_id", F.md5(F.concat_ws(":", F.lit("dialogue"), "title_id", "start_ms", F.array_join("evidence_ids", ",")))), clash


def fuse_other(events: DataFrame, within_ms: int = 1200, low: bool = False) -> DataFrame:
    """Beats that are not dialogue: title_id, seq, type, start_ms, text. Dialogue never makes an action.

    events: title_id, seq, source, kind, start_ms, text, significant, confidence. Bracketed captions are sounds and keep detected sounds
    near them out; silences count if significant, pictures if described, on-screen text if recognized.
    """
    s, k = C("source"), C("kind")
    captions = events.where((s == "subtitle") & is_non_speech(C("text")))
    sounds = events.where(s == "audio-event").select("title_id", "seq", C("start_ms").alias("at_ms"))
    free = suppress_near(sounds, captions.select("title_id", C("start_ms").alias("r_at")), within_ms).select("seq")
    kept = events.where((s == "audio-event") & (F.lit(low) | (k != "unclassified") | (C("confidence") != "unknown"))).join(free.hint("merge"), "seq", "left_semi")
    beat = lambda df, kind: df.select("title_id", "seq", F.lit(kind).alias("type"), "start_ms", "text")
    pictures = events.where((s == "video") & ~F.coalesce(k.isin("scene-change", "setting"), F.lit(False)) & (F.coalesce(C("text"), F.lit("")) != ""))
    written = events.where((s == "ocr") & (F.trim(F.coalesce(C("text"), F.lit(""))) != ""))
    quiet = events.where((s == "audio-silence") & C("significant"))
    return beat(captions, "sound").unionByName(beat(kept, "sound")).unionByName(beat(quiet, "sound")).unionByName(beat(pictures, "action")).unionByName(beat(written, "on-screen-text"))


def order_beats(beats: DataFrame) -> DataFrame:
    """Adds place in the title: by start, then transitions, written text, sounds, actions, dialogue."""
    rank = F.when(C("type") == "transition", 0).when(C("type") == "on-screen-text", 1).when(C("type") == "sound", 2).when(C("type") == "action", 3).otherwise(4)
    return beats.withColumn("place", F.row_number().over(Window.partitionBy("title_id").orderBy("start_ms", rank, "seq")))
