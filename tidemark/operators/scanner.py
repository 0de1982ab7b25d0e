"""Frames against the frame before: metrics by numpy over Arrow batches, and the judgements that depend on what came before.

``scan_frames`` reads a title's frames in order, once. A task holds one Arrow batch and the last frame of the title, so a title
of any length needs the same memory; metrics of a whole batch are array operations. The same rules are a fold for streams
(``Scanner``), whose state is one frame and a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .folds import Fold, whole_keys

C = F.col
METRICS = ["frame_difference", "motion", "cut", "text_change", "face_change", "luminance"]
# Where titles, captions and faces stand in a picture (x, y, width, height).
TITLE, CAPTION, FACE = (0.05, 0.05, 0.9, 0.35), (0.1, 0.72, 0.8, 0.26), (0.2, 0.15, 0.6, 0.55)
# What a flag beside a frame adds to its importance.
BOOSTS = {"near_subtitle": 0.12, "near_speech": 0.15, "near_sound": 0.12, "seek": 0.25}
FLAGS = [*BOOSTS, "reset"]
JUDGED = "redundant boolean, streak long, importance double, event boolean, is_cut boolean, blank boolean, blank_full boolean"


def pair_metrics(before: np.ndarray, now: np.ndarray, width: int, height: int, block: int = 4) -> np.ndarray:
    """METRICS of each row of ``now`` against the same row of ``before``; both hold one luma grid (0 to 255) a row."""
    n, cells = len(now), width * height
    diff = np.abs(now - before)
    grid = diff.reshape(n, height, width)

    def bins(luma: np.ndarray) -> np.ndarray:
        at = np.minimum(31, luma.astype(np.int64) // 8) + 32 * np.arange(n)[:, None]
        return np.bincount(at.ravel(), minlength=32 * n).reshape(n, 32) / cells

    def region(x: float, y: float, w: float, h: float) -> np.ndarray:
        part = grid[:, floor(y * height) : min(height, ceil((y + h) * height)), floor(x * width) : min(width, ceil((x + w) * width))]
        return part.sum((1, 2)) / (part.shape[1] * part.shape[2] * 255.0)

    difference = diff.sum(1) / (cells * 255.0)
    histogram = 1 - np.minimum(bins(now), bins(before)).sum(1)
    rows, columns = range(0, height, block), range(0, width, block)
    sums = np.add.reduceat(np.add.reduceat(grid, rows, 1), columns, 2)
    sizes = np.outer([min(block, height - r) for r in rows], [min(block, width - c) for c in columns])
    blocks = (sums / (sizes * 255.0)).reshape(n, -1)
    mean = blocks.mean(1)
    uneven = np.minimum(1.0, (blocks.max(1) - mean) / np.maximum(mean, 0.02))
    motion = np.where(mean <= 0.001, 0.0, np.minimum(1.0, mean * 4 * (0.4 + 0.6 * uneven)))
    light = now.sum(1) / (cells * 255.0)
    jump = np.abs(light - before.sum(1) / (cells * 255.0))
    cut = np.minimum(1.0, np.maximum(np.sqrt(difference * np.maximum(0.0, histogram)) * 2.2, np.where(jump > 0.35, jump, 0.0)))
    return np.stack([difference, motion, cut, np.maximum(region(*TITLE), region(*CAPTION)), region(*FACE), light], 1)


class Scanner(Fold):
    """Judges frames in order: (seq, at_ms, metrics, redundant, streak, importance, event, is_cut, blank, blank_full).

    A frame without a frame before it (the first, or one marked ``reset``) has no metrics. A redundant frame has no importance
    and lengthens the streak of still frames, any other ends it. ``blank_full`` marks the frame with which the first run of
    ``blanks`` blank frames of the title is full; a reset ends the streak and forgets the last cut, not the run of blank frames.
    """

    def __init__(self, width: int = 32, height: int = 18, least: float = 0.08, blanks: int = 20, block: int = 4) -> None:
        self.size, self.least, self.blanks = (width, height, block), least, blanks
        self.last = self.cut_at = None
        self.streak = self.run = 0
        self.told = False

    def _blank(self, mean: float, std: float) -> tuple[bool, bool]:
        blank = mean < 0.02 and std < 0.01
        self.run = self.run + 1 if blank else 0
        full = self.run >= self.blanks and not self.told
        self.told = self.told or full
        return blank, full

    def judge(self, at: int, metrics: list[float] | None, mean: float, std: float, flags: dict) -> tuple:
        """The judgements of one frame, after those before it. metrics is None where there is no frame before."""
        blank, full = self._blank(mean, std)
        if flags.get("reset"):
            self.streak, self.cut_at = 0, None
        if metrics is None:
            return (False, self.streak, None, False, False, blank, full)
        difference, motion, cut, text, face, light = metrics
        if difference < 0.006 and motion < 0.02 and cut < 0.05:
            self.streak += 1
            return (True, self.streak, None, False, False, blank, full)
        self.streak = 0
        if cut >= 0.6:
            self.cut_at = at
        # fixed values: weights of the metrics, boost after a cut, dark frames
        score = min(1.0, 1.6 * (0.15 * difference + 0.25 * motion + 0.35 * cut + 0.15 * text + 0.1 * face))
        if self.cut_at is not None and at - self.cut_at <= 1500:
            score += 0.2 * (1 - (at - self.cut_at) / 1500)
        score += sum(boost for name, boost in BOOSTS.items() if flags.get(name))
        score = max(0.0, min(1.0, score * 0.3 if light < 0.02 and cut < 0.5 else score))
        return (False, 0, score, score >= self.least, cut >= 0.6, blank, full)

    def push(self, r):
        width, height, block = self.size
        now = np.asarray(r.luma, float)[None]
        flags = {name: getattr(r, name, False) for name in FLAGS}
        before = None if flags["reset"] else self.last
        metrics = None if before is None else pair_metrics(before, now, width, height, block)[0].tolist()
        self.last = now
        told = self.judge(r.at_ms, metrics, now.mean() / 255, now.std() / 255, flags)
        return [(r.seq, r.at_ms, *(metrics or [None] * len(METRICS)), *told)]


def scan_frames(frames: DataFrame, width: int = 32, height: int = 18, least: float = 0.08, blanks: int = 20, block: int = 4) -> DataFrame:
    """title_id, seq, at_ms, METRICS and the judgements of Scanner for every frame.

    frames: title_id, seq, at_ms, luma (``width`` x ``height`` values, row by row) and perhaps the boolean columns of FLAGS
    (null is false). Frames without luma or of another size are left out. Other columns stay out of the result.
    """
    flags = [c for c in FLAGS if c in frames.columns]
    kind = frames.schema["title_id"].dataType.simpleString()
    schema = f"title_id {kind}, seq {frames.schema['seq'].dataType.simpleString()}, at_ms long, {', '.join(m + ' double' for m in METRICS)}, {JUDGED}"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carried, now = None, None, Scanner()
        for b in batches:
            if not b.num_rows:
                continue
            keys, at = b.column("title_id").to_pylist(), b.column("at_ms").to_pylist()
            luma = b.column("luma").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)
            before = np.vstack([luma[:1] if carried is None else carried, luma[:-1]])
            metrics = pair_metrics(before, luma, width, height, block).tolist()
            means, stds = (luma.mean(1) / 255).tolist(), (luma.std(1) / 255).tolist()
            marks = [dict(zip(flags, row)) for row in zip(*(b.column(f).to_pylist() for f in flags))] if flags else [{}] * len(at)
            shown, told = [], []
            for i, k in enumerate(keys):
                fresh = carried is None or k != key
                if fresh:
                    key, now = k, Scanner(width, height, least, blanks, block)
                seen = None if fresh or marks[i].get("reset") else metrics[i]
                carried = luma[i : i + 1]
                shown.append(seen or [None] * len(METRICS))
                told.append(now.judge(at[i], seen, means[i], stds[i], marks[i]))
            columns = [b.column("title_id"), b.column("seq"), b.column("at_ms"), *zip(*shown), *zip(*told)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    rows = frames.where(F.size("luma") == width * height).where(~F.exists("luma", lambda x: x.isNull()))
    rows = rows.select("title_id", "seq", C("at_ms").cast("long").alias("at_ms"), C("luma").cast("array<int>").alias("luma"), *flags)
    return whole_keys(rows, ["title_id"]).sortWithinPartitions("title_id", "at_ms", "seq").mapInArrow(run, schema)


def scan_report(scanned: DataFrame) -> DataFrame:
    """title_id, observations, events, redundant, cuts, blanks, longest_streak, blank_at (when the first blank run was full), fps."""
    seconds = (F.max("at_ms") - F.min("at_ms")) / 1000
    return scanned.groupBy("title_id").agg(
        F.count("*").alias("observations"), F.count_if("event").alias("events"), F.count_if("redundant").alias("redundant"), F.count_if("is_cut").alias("cuts"), F.count_if("blank").alias("blanks"),
        F.max("streak").alias("longest_streak"), F.min(F.when(C("blank_full"), C("at_ms"))).alias("blank_at"), F.when(seconds > 0, (F.count("*") - 1) / seconds).otherwise(0.0).alias("fps"),
    )
