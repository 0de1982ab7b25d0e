"""Frames of audio over the borders of chunks, against loops over single samples."""

import cmath
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans.signals import audio_frames, downmix, mel_bank
from tidemark.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "title_id long, chunk long, first_sample long, sample_rate int, samples array<double>"


def spectrum(x):
    n, size = len(x), 1
    while size < n:
        size *= 2
    w = [v * 0.5 * (1 - math.cos(2 * math.pi * i / (n - 1))) for i, v in enumerate(x)]
    turn = [cmath.exp(-2j * math.pi * t / size) for t in range(size)]
    return [abs(sum(v * turn[k * i % size] for i, v in enumerate(w))) / (size // 2) for k in range(size // 2)]


def cepstrum(spec, rate, bands=20, kept=13):
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    top = min(8000, rate / 2)
    edge = [700 * (10 ** ((mel(80) + (mel(top) - mel(80)) * i / (bands + 1)) / 2595) - 1) / (rate / 2) * len(spec) for i in range(bands + 2)]
    logs = []
    for a, b, c in zip(edge, edge[1:], edge[2:]):
        energy = sum(v * ((k - a) / (b - a) if k < b else (c - k) / (c - b)) for k, v in enumerate(spec) if a < k < c)
        logs.append(math.log(max(1e-10, energy)))
    return [sum(e * math.cos(math.pi * k * (i + 0.5) / bands) for i, e in enumerate(logs)) for k in range(kept)]


def resampled(chunks, rate):
    """place -> sample of one title at the wanted rate."""
    out = {}
    for of in sorted({c[3] for c in chunks}, reverse=True):
        held = {}
        for _, _, first, r, samples in sorted((c for c in chunks if c[3] == of), key=lambda c: (c[2], c[1])):
            for i, v in enumerate(samples):
                held.setdefault(first + i, v or 0.0)
        for j in range((max(held) + 1) * rate // of + 2):
            p, share = j * of // rate, j * of % rate / rate
            if p in held and (p + 1 in held or (j + 1) * of <= (p + 1) * rate):
                out.setdefault(j, held[p] * (1 - share) + held.get(p + 1, held[p]) * share)
    return out


def looped(rows, rate, frame, hop):
    out = {}
    for title in {r[0] for r in rows}:
        y = resampled([r for r in rows if r[0] == title], rate)
        last = None
        for k in range(max(y) // hop + 1):
            x = [y.get(k * hop + i) for i in range(frame)]
            if None in x:
                last = None
                continue
            spec = spectrum(x)
            total = sum(spec)
            heard = [max(v, 1e-10) for v in spec]
            out[title, k] = (
                sum(max(0, b - a) for a, b in zip(last, spec)) if last else 0.0,
                max(-100, 20 * math.log10(max(1e-5, math.sqrt(sum(v * v for v in x) / frame)))),
                sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:])) / (frame - 1),
                sum(i * rate / 2 / len(spec) * v for i, v in enumerate(spec)) / total if total else 0.0,
                min(1, math.exp(sum(map(math.log, heard)) / len(spec)) / (sum(heard) / len(spec))) if total else 0.0,
                *cepstrum(spec, rate),
            )
            last = spec
    return out


def given(seed):
    """Three titles: chunks of unlike lengths with gaps; two rates with repeated and overlapping rows; silence with nulls."""
    r = random.Random(seed)
    rows, at = [], 0
    for c in range(30):
        n = r.choice([1, 3, 40, 200])
        rows.append((1, c, at, 8000, [r.uniform(-1, 1) for _ in range(n)]))
        at += n + (r.choice([1, 50]) if c % 11 == 10 else 0)
    for c in range(4):
        rows.append((2, c, c * 150, 16000 if c % 2 else 8000, [r.uniform(-1, 1) for _ in range(300)]))
    rows += [rows[-1], (3, 0, 0, 8000, [0.0] * 100 + [None] * 60), (3, 0, 160, 8000, [])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("rate", "frame", "hop", "per_block"), [(8000, 64, 24, 3), (8000, 30, 45, 1), (6000, 64, 16, 5), (11025, 40, 40, 2), (8000, 64, 24, 100)])
def test_frames_by_loops(spark, rate, frame, hop, per_block):
    rows = given(rate + hop)
    want = looped(rows, rate, frame, hop)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"block": F.lit("clash"), "rate": F.lit(None)})
    got = {(r.title_id, r.frame): r for r in audio_frames(df, rate, frame, hop, per_block).collect()}
    assert set(got) == set(want) and len(want) > 20
    for key, r in got.items():
        assert r.start_ms == key[1] * hop * 1000 // rate
        assert (r.flux, r.db, r.zcr, r.centroid, r.flatness, *r.mfcc) == pytest.approx(want[key], rel=1e-6, abs=1e-6)


def test_batches_cut_a_block(spark):
    rows = given(5)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, audio_frames(df, 8000, 64, 24, 7).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        parts = sorted(map(tuple, audio_frames(df, 8000, 64, 24, 7).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == parts


def test_nothing_to_hear(spark):
    rows = [(1, 0, None, 8000, [1.0]), (1, 1, 0, 0, [1.0]), (1, 2, 0, 8000, None), (1, 3, 0, 8000, [1.0] * 9), (None, 4, 0, None, [1.0])]
    assert audio_frames(spark.createDataFrame(rows, SCHEMA), 8000, 64, 24).count() == 0
    assert audio_frames(spark.createDataFrame([], SCHEMA)).count() == 0


def test_downmix(spark):
    df = spark.createDataFrame([([1.0, 0.0, -1.0, 0.5, 9.0],), ([None, 1.0],), ([],), ([3.0],), (None,)], "x array<double>")
    assert [r.m for r in df.select(downmix("x", 2).alias("m")).collect()] == [[0.5, -0.25], [0.5], [], [], []]


def test_filters_overlap_their_neighbours():
    bank = mel_bank(256, 16_000)
    assert bank.shape == (20, 256) and (bank >= 0).all() and bank.max() <= 1 and (np.diff(bank.argmax(axis=1)) > 0).all()


def test_frame_spectra_of_the_tables(spark):
    """Every tenth place of the frames' grid, on whole titles."""
    vectors = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect():
        vectors.setdefault(r.label, []).extend([float(v) * 0.75 for v in r.embedding] * 8)
    got = {(r.title_id, r.frame): r for r in QUERIES["p15_frame_spectra"](spark, SF).collect()}
    assert set(got) == {(t, k) for t, x in vectors.items() for k in range((len(x) - 400) // 160 + 1)}
    for t, x in vectors.items():
        for k in range(0, (len(x) - 400) // 160 + 1, 40):
            spec = spectrum(x[k * 160 : k * 160 + 400])
            before = spectrum(x[k * 160 - 160 : k * 160 + 240]) if k else None
            r = got[t, k]
            assert r.flux == pytest.approx(sum(max(0, b - a) for a, b in zip(before, spec)) if before else 0.0, rel=1e-6)
            assert r.mfcc == pytest.approx(cepstrum(spec, 16_000), rel=1e-6, abs=1e-6)
