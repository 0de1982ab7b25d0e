"""The scan, the store that evicts and the dense plan against plain loops."""

import math
import random

import pytest

from tidemark.operators import folds, scanner, sequences
from tidemark.operators.folds import ordered_fold

W, H = 6, 5
FRAMES = "title_id long, seq long, at_ms long, luma array<int>, near_speech boolean, seek boolean, reset boolean, cut double"


def made_frames():
    r, rows = random.Random(5), []
    for title in (1, 2, None):
        luma = [r.randrange(256) for _ in range(W * H)]
        for k in range(70):
            how = r.randrange(6) if not 30 <= k < 45 else 5
            if how < 2:
                luma = [min(255, max(0, x + r.randrange(-60, 60))) for x in luma]
            elif how == 2:
                luma = [r.randrange(256) for _ in luma]
            elif how == 5:
                luma = [r.randrange(2) for _ in luma]
            rows.append((title, k, k * r.choice((200, 200, 900)) if k % 9 else k * 200, list(luma), r.choice((True, False, None)), r.random() < 0.1, r.random() < 0.06, 9.0))
    return [*rows, (1, 900, 1, None, True, True, True, 1.0), (1, 901, 2, [1, 2], False, False, False, 1.0)]


def by_loops(rows, blanks):
    out, titles = {}, {}
    for x in rows:
        if x[3] is not None and len(x[3]) == W * H:
            titles.setdefault(x[0], []).append(x)
    for title, mine in titles.items():
        mine.sort(key=lambda x: (x[2], x[1]))
        before, cut_at, streak, run, told = None, None, 0, 0, False
        for _, seq, at, luma, speech, seek, reset, _ in mine:
            n, mean = W * H, sum(luma) / (W * H)
            dark = mean / 255 < 0.02 and math.sqrt(sum((x - mean) ** 2 for x in luma) / n) / 255 < 0.01
            run = run + 1 if dark else 0
            full = run == blanks and not told
            told = told or full
            if reset:
                before, cut_at, streak = None, None, 0
            was, before = before, luma
            if was is None:
                out[title, seq] = (None, False, streak, None, False, False, dark, full)
                continue
            d = [abs(a - b) for a, b in zip(luma, was)]
            at_xy = lambda x0, x1, y0, y1: [d[y * W + x] for y in range(y0, y1) for x in range(x0, x1)]  # noqa: B023, E731
            share = lambda v: [sum(min(31, x // 8) == b for x in v) / n for b in range(32)]  # noqa: B023, E731
            change, far = sum(d) / n / 255, 1 - sum(map(min, share(luma), share(was)))
            blocks = [sum(c) / len(c) / 255 for y in (0, 4) for x in (0, 4) for c in [at_xy(x, min(W, x + 4), y, min(H, y + 4))]]
            m = sum(blocks) / len(blocks)
            motion = 0 if m <= 0.001 else min(1, m * 4 * (0.4 + 0.6 * min(1, (max(blocks) - m) / max(m, 0.02))))
            jump = abs(sum(luma) - sum(was)) / n / 255
            cut = min(1, max(2.2 * math.sqrt(change * max(0, far)), jump if jump > 0.35 else 0))
            part = lambda x, y, w, h: (lambda c: sum(c) / len(c) / 255)(at_xy(math.floor(x * W), min(W, math.ceil((x + w) * W)), math.floor(y * H), min(H, math.ceil((y + h) * H))))
            if change < 0.006 and motion < 0.02 and cut < 0.05:
                streak += 1
                out[title, seq] = (change, True, streak, None, False, False, dark, full)
                continue
            streak, cut_at = 0, at if cut >= 0.6 else cut_at
            text, face = max(part(0.05, 0.05, 0.9, 0.35), part(0.1, 0.72, 0.8, 0.26)), part(0.2, 0.15, 0.6, 0.55)
            score = min(1, 1.6 * (0.15 * change + 0.25 * motion + 0.35 * cut + 0.15 * text + 0.1 * face))
            if cut_at is not None and at - cut_at <= 1500:
                score += 0.2 * (1 - (at - cut_at) / 1500)
            score += (0.15 if speech else 0) + (0.25 if seek else 0)
            score = min(1, score * 0.3 if mean / 255 < 0.02 and cut < 0.5 else score)
            out[title, seq] = (change, False, 0, score, score >= 0.08, cut >= 0.6, dark, full)
    return out


def told(rows):
    names = "frame_difference redundant streak importance event is_cut blank blank_full".split()
    return {(r.title_id, r.seq): tuple(pytest.approx(r[n]) if isinstance(r[n], float) else r[n] for n in names) for r in rows}


def test_scan_carries_over_batches_and_resets(spark):
    rows = made_frames()
    df, want = spark.createDataFrame(rows, FRAMES), by_loops(rows, 8)
    flags = [x[1:] for x in want.values()]
    assert {x[0] for x in flags} == {x[3] for x in flags} == {x[4] for x in flags} == {x[6] for x in flags} == {True, False} and max(x[1] for x in flags) > 1
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (1, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = scanner.scan_frames(df, W, H, blanks=8).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
        assert len(found) == len(want) and told(found) == want
    report = {r.title_id: r for r in scanner.scan_report(scanner.scan_frames(df, W, H, blanks=8)).collect()}
    for title in (1, 2, None):
        mine = [x for (t, _), x in want.items() if t == title]
        got = report[title]
        assert (got.observations, got.events, got.redundant, got.cuts, got.blanks, got.longest_streak) == (len(mine), *(sum(x[i] for x in mine) for i in (4, 1, 5, 6)), max(x[2] for x in mine))


def test_scanner_as_a_fold(spark):
    rows = [x for x in made_frames() if x[3] and len(x[3]) == W * H]
    df = spark.createDataFrame(rows, FRAMES)
    schema = "title_id long, seq long, at_ms long, " + ", ".join(m + " double" for m in scanner.METRICS) + ", " + scanner.JUDGED
    assert told(ordered_fold(df, ["title_id"], ["at_ms", "seq"], lambda: scanner.Scanner(W, H, blanks=8), schema).collect()) == by_loops(rows, 8)


def test_scan_of_nothing(spark):
    none = spark.createDataFrame([], FRAMES)
    assert scanner.scan_frames(none, W, H).count() == 0 and scanner.scan_report(scanner.scan_frames(none, W, H)).count() == 0
    lone = spark.createDataFrame([(1, 0, 0, [0] * (W * H), None, None, None, 0.0)], FRAMES)
    assert [(r.observations, r.events, r.blanks, r.fps) for r in scanner.scan_report(scanner.scan_frames(lone, W, H)).collect()] == [(1, 0, 1, 0.0)]
    assert sequences.scan(lone, W, H).count() == 0


def test_evict_by_loops(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [(t, k, r.randrange(1000), float(r.randrange(5))) for t in (1, 2) for k in range(97 if t == 1 else 12)]
    df = spark.createDataFrame(rows, "title_id long, seq long, start_ms long, worth double")
    got = sorted((x.title_id, x.seq) for x in sequences.evict(df, F.col("worth"), 20).collect())
    want = []
    for t in (1, 2):
        held = []
        for _, seq, at, worth in (x for x in rows if x[0] == t):
            held.append((worth, at, seq))
            if len(held) > 20:
                held = sorted(held)[2:]
        want += [(t, x[2]) for x in held]
    assert got == sorted(want)


def test_dense_plan_with_given_windows(spark):
    r = random.Random(8)
    given = [(1, k, a, 0.0, None, 0, a + r.randrange(-20, 3000)) for k, a in enumerate(r.randrange(60_000) for _ in range(12))]
    moments = [(1, 100 + k, r.randrange(60_000), w, -w, 61_000, None) for k, w in enumerate(float(r.randrange(9)) for _ in range(60))]
    df = spark.createDataFrame(given + moments, "title_id long, seq long, at_ms long, weight double, order double, duration_ms long, until long")
    got = sorted(tuple(x) for x in ordered_fold(df, ["title_id"], ["order", "at_ms", "seq"], lambda: folds.DensePlan(2500, 700, 9), "title_id long, start_ms long, end_ms long, importance double").collect())
    covered, want = [(x[2], x[6]) for x in given], []
    for _, _, at, w, _, duration, _ in sorted(moments, key=lambda x: (x[4], x[2], x[1])):
        if len(want) < 9 and not any(a <= at <= b for a, b in covered):
            start = max(0, min(at - 700, duration - 2500))
            covered.append((start, start + 2500))
            want.append((1, start, start + 2500, w))
    assert got == sorted(want) and len(got) == 9
