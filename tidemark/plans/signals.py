"""Numeric features of PCM chunks and pictures: numpy kernels in Arrow batches, a row in, a row out."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.folds import whole_keys
from ..operators.intervals import overlap_join

C = F.col


@lru_cache
def mel_bank(n_bins: int, rate: int, bands: int = 20, low: int = 80, high: int = 8000) -> np.ndarray:
    """Triangular filters at even steps of the mel scale, over bins at even steps below half the rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(min(high, rate / 2)), bands + 2) / 2595) - 1)
    f = (np.arange(n_bins) * (rate / 2 / n_bins))[None, :]
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid)))


def frame_features(x: np.ndarray, rate: int, bands: int = 20, kept: int = 13) -> tuple[np.ndarray, ...]:
    """db, zcr, centroid, flatness, mfcc, spectrum of frames, one in each row of x; magnitudes are shares of the number of bins."""
    n = x.shape[1]
    level = np.maximum(-100.0, 20 * np.log10(np.maximum(np.sqrt((x * x).mean(axis=1)), 1e-5)))
    up = x >= 0
    zcr = (up[:, 1:] != up[:, :-1]).sum(axis=1) / max(1, n - 1)
    bins = (1 << max(1, (n - 1).bit_length())) // 2
    spec = np.abs(np.fft.rfft(x * np.hanning(n), 2 * bins, axis=1))[:, :bins] / bins
    total = spec.sum(axis=1)
    centroid = np.divide(spec @ (np.arange(bins) * (rate / 2 / bins)), total, out=np.zeros(len(x)), where=total > 0)
    heard = np.maximum(spec, 1e-10)
    flat = np.where(total > 0, np.minimum(1, np.exp(np.log(heard).mean(axis=1)) / heard.mean(axis=1)), 0.0)
    energy = np.log(np.maximum(spec @ mel_bank(bins, rate, bands).T, 1e-10))
    k, i = np.arange(kept)[None, :], np.arange(bands)[:, None]
    return level, zcr, centroid, flat, energy @ np.cos(np.pi * k * (i + 0.5) / bands), spec


def spectrum_features(x: np.ndarray, rate: int, bands: int = 20, kept: int = 13) -> tuple:
    """db, zcr, centroid, flatness, spectrum_sum, mfcc of one frame."""
    level = max(-100.0, 20 * np.log10(max(float(np.sqrt(np.mean(x * x))), 1e-5))) if len(x) else -100.0
    zcr = float(np.mean((x[1:] >= 0) != (x[:-1] >= 0))) if len(x) > 1 else 0.0
    size = 1 << max(1, (max(2, len(x)) - 1).bit_length())
    spec = np.abs(np.fft.rfft(x * np.hanning(len(x)), size)) if len(x) else np.zeros(2)
    freq = np.linspace(0, rate / 2, len(spec))
    total = float(spec.sum())
    centroid = float((freq * spec).sum() / total) if total else 0.0
    flat = float(np.exp(np.mean(np.log(spec + 1e-10))) / (np.mean(spec) + 1e-10))
    mfcc = frame_features(x[None, :], rate, bands, kept)[4][0] if len(x) else np.zeros(kept)
    return level, zcr, centroid, flat, total, mfcc.tolist()


def audio_features(chunks: DataFrame) -> DataFrame:
    """title_id, chunk, start_ms, db, zcr, centroid, flatness, spectrum_sum, mfcc of every chunk (one frame each)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, c, s, *spectrum_features(np.asarray(x, float), int(r))) for t, c, s, r, x in zip(b.title_id, b.chunk, b.start_ms, b.sample_rate, b.samples)]
            yield pd.DataFrame(rows, columns=["title_id", "chunk", "start_ms", "db", "zcr", "centroid", "flatness", "spectrum_sum", "mfcc"])

    return chunks.mapInPandas(run, "title_id long, chunk long, start_ms long, db double, zcr double, centroid double, flatness double, spectrum_sum double, mfcc array<double>")


def downmix(samples: str | Column, channels: int) -> Column:
    """The mean of interleaved channels; an incomplete last instant goes, null is silence."""
    x = C(samples) if isinstance(samples, str) else samples
    one = lambda c: F.slice(F.filter(x, lambda _, i: i % channels == c), 1, F.floor(F.size(x) / channels).cast("int"))
    value = lambda v: F.coalesce(v.cast("double"), F.lit(0.0))
    total = reduce(lambda s, c: F.zip_with(s, one(c), lambda u, v: u + value(v)), range(1, channels), F.transform(one(0), value))
    return F.when(F.size(x) >= channels, F.transform(total, lambda v: v / channels)).otherwise(F.array().cast("array<double>"))


class _Block:
    """Samples of one block of frames, laid at their places; what is there already stays."""

    def __init__(self, block: int, rate: int, frame: int, hop: int, most: int) -> None:
        self.block, self.rate, self.frame, self.hop, self.most = block, rate, frame, hop, most
        self.low = max(0, (block * most - 1) * hop)
        self.high = ((block + 1) * most - 1) * hop + frame
        self.held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

    def add(self, rate: int, at: int, part: np.ndarray) -> None:
        origin = self.low * rate // self.rate
        if rate not in self.held:
            size = (self.high - 1) * rate // self.rate + 2 - origin
            self.held[rate] = origin, np.zeros(size), np.zeros(size, bool)
        _, buffer, there = self.held[rate]
        here = slice(at - origin, at - origin + len(part))
        buffer[here] = np.where(there[here], buffer[here], part)
        there[here] = True

    def signal(self) -> tuple[np.ndarray, np.ndarray]:
        """The samples at the wanted rate and which of them exist."""
        i = np.arange(self.low, self.high)
        out, known = np.zeros(len(i)), np.zeros(len(i), bool)
        for rate, (origin, buffer, there) in self.held.items():
            left, share = i * rate // self.rate, i * rate % self.rate / self.rate
            follows = there[left - origin + 1]
            value = buffer[left - origin] * (1 - share) + np.where(follows, buffer[left - origin + 1], buffer[left - origin]) * share
            new = there[left - origin] & (follows | ((i + 1) * rate <= (left + 1) * self.rate)) & ~known
            out[new], known = value[new], known | new
        return out, known

    def rows(self) -> list[tuple]:
        x, known = self.signal()
        k = np.arange(max(0, self.block * self.most - 1), (self.block + 1) * self.most)
        at = k * self.hop - self.low
        count = np.concatenate([[0], np.cumsum(known)])
        whole = count[at + self.frame] - count[at] == self.frame
        k, at = k[whole], at[whole]
        if not len(k):
            return []
        *columns, spec = frame_features(np.lib.stride_tricks.sliding_window_view(x, self.frame)[at], self.rate)
        flux = np.concatenate([[0.0], np.where(np.diff(k) == 1, np.maximum(0, np.diff(spec, axis=0)).sum(axis=1), 0.0)])
        own = k >= self.block * self.most
        return [x for x, mine in zip(zip(k.tolist(), (k * self.hop * 1000 // self.rate).tolist(), flux.tolist(), *(c.tolist() for c in columns)), own) if mine]


def audio_frames(chunks: DataFrame, rate: int = 16_000, frame: int = 400, hop: int = 160, per_block: int = 100) -> DataFrame:
    """title_id, frame, start_ms, flux, db, zcr, centroid, flatness, mfcc of ``frame`` samples at each ``hop``, at ``rate``.

    chunks: title_id, chunk, first_sample (its place in the title at its own rate), sample_rate, samples (one channel). Frames lie
    on one grid from the title's start and run over the borders of chunks; other rates are brought to ``rate`` by linear
    interpolation, over borders too. Samples at one place count once, those of the higher rate, earlier start and lesser chunk
    first; null samples are silence. A frame that meets a gap is not given; after a gap, and at the start, flux is 0. Chunks
    without samples, rate or place are left out.

    Each block of frames is a key of its own: a chunk is cut for the blocks that need it, with the frame before and the sample
    after, so a title of any length is as many tasks as it has blocks, and each holds one block.
    """
    span = per_block * hop
    c = chunks.where("first_sample >= 0 and sample_rate > 0 and size(samples) > 0").withColumn("_end", C("first_sample") + F.size("samples"))
    first = f"greatest(0L, first_sample * {rate} div sample_rate - {frame + span}L) div {span}"
    c = c.withColumn("_block", F.explode(F.expr(f"sequence({first}, (_end * {rate} div sample_rate + {hop + 1}) div {span})")))
    c = c.withColumn("_from", F.expr(f"greatest(first_sample, greatest(0L, _block * {span} - {hop}) * sample_rate div {rate})"))
    c = c.withColumn("_to", F.expr(f"least(_end, (_block * {span} + {span - hop + frame - 1}) * sample_rate div {rate} + 2)")).where("_to > _from")
    part = F.slice("samples", (C("_from") - C("first_sample") + 1).cast("int"), (C("_to") - C("_from")).cast("int"))
    parts = c.select(C("title_id").cast("long").alias("title_id"), C("_block").cast("long").alias("block"), C("sample_rate").cast("long").alias("rate"), C("first_sample").cast("long").alias("first_sample"), C("chunk").cast("long").alias("chunk"), C("_from").cast("long").alias("at"), part.cast("array<double>").alias("part"))
    schema = "title_id long, frame long, start_ms long, flux double, db double, zcr double, centroid double, flatness double, mfcc array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in schema.split(", ")]
        types = [pa.int64()] * 3 + [pa.float64()] * 5 + [pa.list_(pa.float64())]
        give = lambda title, rows: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*((title, *r) for r in rows)), types)], names=names)
        key, now = None, None
        for b in batches:
            title, block, of, at = (b.column(n).to_pylist() for n in ("title_id", "block", "rate", "at"))
            column = b.column("part")
            for i in range(b.num_rows):
                if (title[i], block[i]) != key:
                    if now is not None and (rows := now.rows()):
                        yield give(key[0], rows)
                    key, now = (title[i], block[i]), _Block(block[i], rate, frame, hop, per_block)
                values = column[i].values.fill_null(0.0)
                now.add(of[i], at[i], values.to_numpy(zero_copy_only=False))
        if now is not None and (rows := now.rows()):
            yield give(key[0], rows)

    keys = ["title_id", "block"]
    return whole_keys(parts, keys).sortWithinPartitions(*keys, F.desc("rate"), "first_sample", "chunk").mapInArrow(run, schema)


def frame_signatures(pictures: DataFrame, width: int = 32, height: int = 18) -> DataFrame:
    """seq, luma (box means of the grid, rounded half up), histogram (32 bins), mean, std, blank. pictures: seq, width, height, rgba."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for seq, w, h, rgba in zip(b.seq, b.width, b.height, b.rgba):
                p = np.asarray(rgba, float).reshape(h, w, 4)
                y = 0.299 * p[:, :, 0] + 0.587 * p[:, :, 1] + 0.114 * p[:, :, 2]
                ys, xs = (np.linspace(0, n, k + 1).astype(int) for n, k in ((h, height), (w, width)))
                luma = np.array([[y[ys[i] : max(ys[i] + 1, ys[i + 1]), xs[j] : max(xs[j] + 1, xs[j + 1])].mean() for j in range(width)] for i in range(height)]).ravel()
                grid = np.floor(np.round(luma, 9) + 0.5).astype(int)
                rows.append((seq, grid.tolist(), (np.bincount(np.minimum(31, grid // 8), minlength=32) / len(grid)).tolist(), float(grid.mean() / 255), float(grid.std() / 255)))
            yield pd.DataFrame(rows, columns=["seq", "luma", "histogram", "mean", "std"])

    out = pictures.mapInPandas(run, "seq long, luma array<int>, histogram array<double>, mean double, std double")
    return out.withColumn("blank", (C("mean") < 0.02) & (C("std") < 0.01))


def slice_pcm(chunks: DataFrame, windows: DataFrame) -> DataFrame:
    """title_id, seq, samples of each window (start_ms, end_ms), from the first sample at or before its start to the last before its end."""
    length = F.floor(F.size("samples") * 1000 / C("sample_rate"))
    c = chunks.select("title_id", C("start_ms").alias("r_start"), (C("start_ms") + length).alias("r_end"), "sample_rate", "samples")
    hits = overlap_join(windows, c, 1000)
    first = F.greatest(F.lit(0), F.floor((C("start_ms") - C("r_start")) * C("sample_rate") / 1000)).cast("int")
    last = F.least(F.size("samples"), F.ceil((C("end_ms") - C("r_start")) * C("sample_rate") / 1000).cast("int"))
    cut = hits.select("title_id", "seq", "r_start", F.slice("samples", first + 1, F.greatest(F.lit(0), last - first)).alias("part"))
    return cut.groupBy("title_id", "seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r_start", "part"))), lambda x: x["part"])).alias("samples"))
