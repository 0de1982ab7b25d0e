"""Queries without SQL, and operators' edges, against plain loops."""

import cmath
import math
import random

import pytest

from tests.test_oracles import SF
from tidemark.bindings import views
from tidemark.operators import folds, intervals, sequences
from tidemark.operators.folds import ordered_fold
from tidemark.plans import characters, project
from tidemark.queries import QUERIES


def test_fold_keeps_nulls_and_longs(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(None, big, 5), (None, big + 1, None), (7, big + 2, 0), (7, big + 3, 10_000)], "title_id long, seq long, at_ms long").where("at_ms is not null or seq > 0")
    out = ordered_fold(df.na.fill({"at_ms": 9000}), ["title_id"], ["at_ms", "seq"], lambda: folds.Throttle(2000), "title_id long, seq long, at_ms long")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(None, big, 5), (None, big + 1, 9000), (7, big + 2, 0), (7, big + 3, 10_000)], key=repr)


def test_missing_ends_are_points(spark):
    left = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 50, None)], "title_id long, seq long, start_ms long, end_ms long")
    right = spark.createDataFrame([(1, 10, 40, None), (1, 11, 100, None), (1, 12, 10, 60), (1, 13, None, None)], "title_id long, r_seq long, r_start long, r_end long")
    pairs = lambda **o: sorted((r.seq, r.r_seq) for r in intervals.overlap_join(left, right, 30, **o).collect())
    assert pairs(closed=True) == [(1, 10), (1, 12), (2, 12)]
    assert pairs() == [(1, 10), (1, 12), (2, 12)]


def test_corrections_of_all_kinds(spark):
    r = random.Random(2)
    lines = [(t, i, r.randrange(100), f"c{r.randrange(4)}", f"s{r.randrange(3)}") for t in (1, 2) for i in range(60)]
    log = [(t, k, r.choice(("single", "forward", "merge", "split", "remove", "rename")), f"c{r.randrange(5)}", f"c{r.randrange(5)}", r.randrange(60), r.randrange(100), f"s{r.randrange(3)}", "x") for t in (1, 3) for k in range(25)]
    want = {}
    for t, i, at, who, speaker in lines:
        for title, _, op, a, b, line, since, s, _ in log:
            if title == t and (op == "single" and line == i or who == a and (op in ("merge", "remove") or op == "forward" and at >= since or op == "split" and speaker == s)):
                who = None if op == "remove" else b
        want[t, i] = who
    out = characters.apply_corrections(spark.createDataFrame(lines, "title_id long, seq long, at_ms long, character_id string, speaker_id string"), spark.createDataFrame(log, "title_id long, log_seq long, op string, from_id string, to_id string, line_seq long, at_ms long, speaker_id string, name string"))
    assert {(x.title_id, x.seq): x.character_id for x in out.collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_long_logs_with_gaps(spark, seed):
    r = random.Random(seed)
    maybe = lambda x: None if r.random() < 0.08 else x
    ops = ("single", "forward", "forward", "forward", "merge", "split", "split", "rename") + ("remove",) * (seed % 2)
    lines = [(maybe(t), i % 90, maybe(r.randrange(40)), maybe(f"c{r.randrange(6)}"), maybe(f"s{r.randrange(4)}")) for t in (1, 2) for i in range(160)]
    log = [(maybe(t), k, r.choice(ops), maybe(f"c{r.randrange(7)}"), maybe(f"c{r.randrange(7)}"), maybe(r.randrange(120)), maybe(r.randrange(40)), maybe(f"s{r.randrange(4)}")) for t in (1, 2, 3) for k in range(70)]
    same = lambda x, y: x is not None and x == y
    want = []
    for t, i, at, who, speaker in lines:
        for title, _, op, a, b, line, since, s in log:
            late = at is not None and since is not None and at >= since
            if same(t, title) and (op == "single" and same(line, i) or same(who, a) and (op in ("merge", "remove") or op == "forward" and late or op == "split" and same(speaker, s))):
                who = None if op == "remove" else b
        want.append((t, i, at, who))
    out = characters.apply_corrections(
        spark.createDataFrame(lines, "title_id long, seq long, at_ms long, character_id string, speaker_id string"),
        spark.createDataFrame(log, "title_id long, log_seq long, op string, from_id string, to_id string, line_seq long, at_ms long, speaker_id string"),
    )
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_corrected_characters(spark):
    people = spark.createDataFrame([(1, "c1", "ANNA", 10, 3), (1, "c2", "ANNIE", 5, 2), (1, "c3", "BEN", 7, 1), (1, "c4", None, 8, 4)], "title_id long, character_id string, name string, first_ms long, lines long")
    log = spark.createDataFrame([(1, 1, "merge", "c2", "c1", None), (1, 2, "rename", "c4", None, "Zoe"), (1, 3, "rename", "c4", None, "Zoë"), (1, 4, "remove", "c3", None, None)], "title_id long, log_seq long, op string, from_id string, to_id string, name string").selectExpr("*", "cast(null as long) line_seq", "cast(null as long) at_ms")
    out = {r.character_id: (r.name, r.aliases, r.first_ms, r.lines, r.source, r.confidence) for r in characters.corrected_characters(people, log).collect()}
    assert out == {"c1": ("ANNA", ["ANNIE"], 5, 5, "user", "high"), "c4": ("ZOË", ["ZOE"], 8, 4, "user", "high")}


def test_online_clustering(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        rows.setdefault(r.vec_id % 20, []).append((r.vec_id, [float(x) for x in r.embedding]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {}
    for title, items in rows.items():
        groups, last = [], None
        for seq, x in sorted(items):
            far = [1 - dot(x, c) / math.sqrt(dot(x, x) * dot(c, c)) for c, _ in groups]
            k = min(range(len(far)), key=far.__getitem__) if far else None
            d = far[k] if far else None
            if k is not None and (d <= 0.6 or len(groups) >= 12):
                c, n = groups[k]
                groups[k] = [(u * n + v) / (n + 1) for u, v in zip(c, x)], n + 1
            else:
                k = len(groups)
                groups.append((x, 1))
            want[seq] = (f"speaker-{k + 1:03d}", last is not None and last != k, "unknown" if d is None or d > 0.9 else "low" if d > 0.6 else "medium" if d > 0.3 else "high")
            last = k
    out = {r.seq: (r.speaker, r.turn_change, r.confidence) for r in QUERIES["w20_online_clustering"](spark, SF).collect()}
    assert out == want


def test_scan_by_loops(spark):
    out = {r.seq: r for r in QUERIES["w23_w25_scan"](spark, SF).collect()}
    titles = {}
    for f in views.frames(spark, SF).collect():
        titles.setdefault(f.title_id, []).append(f)
    found = {}
    for frames in titles.values():
        frames.sort(key=lambda f: (f.at_ms, f.seq))
        cut_at = None
        for p, f in zip(frames, frames[1:]):
            diff = [abs(a - b) for a, b in zip(f.luma, p.luma)]
            change = sum(diff) / (64 * 255)
            distance = 1 - sum(min(a, b) for a, b in zip(f.histogram, p.histogram))
            blocks = [sum(diff[y * 8 + x] for y in range(by, by + 4) for x in range(bx, bx + 4)) / (16 * 255) for by in (0, 4) for bx in (0, 4)]
            mean = sum(blocks) / 4
            motion = 0 if mean <= 0.001 else min(1, mean * 4 * (0.4 + 0.6 * min(1, (max(blocks) - mean) / max(mean, 0.02))))
            jump = abs(f.mean - p.mean)
            cut = min(1, max(2.2 * math.sqrt(max(0, change) * max(0, distance)), jump if jump > 0.35 else 0))
            if change < 0.006 and motion < 0.02 and cut < 0.05:
                continue
            part = lambda x, y, w, h: (lambda c: sum(diff[k] for k in c) / (len(c) * 255))([r * 8 + q for r in range(math.floor(y * 8), min(8, math.ceil((y + h) * 8))) for q in range(math.floor(x * 8), min(8, math.ceil((x + w) * 8)))])  # noqa: B023, E731
            text, face = max(part(0.05, 0.05, 0.9, 0.35), part(0.1, 0.72, 0.8, 0.26)), part(0.2, 0.15, 0.6, 0.55)
            if cut >= 0.6:
                cut_at = f.at_ms
            score = min(1, 1.6 * (0.15 * change + 0.25 * motion + 0.35 * cut + 0.15 * text + 0.1 * face))
            if cut_at is not None and f.at_ms - cut_at <= 1500:
                score += 0.2 * (1 - (f.at_ms - cut_at) / 1500)
            score = max(0, min(1, score * 0.3 if f.mean < 0.02 and cut < 0.5 else score))
            if score >= 0.08:
                found[f.seq] = score
    assert set(out) == set(found) and out
    assert all(abs(out[k].importance - v) < 1e-6 for k, v in found.items())


def test_importance_decays_on_static_streaks(spark):
    rows = [(1, k, k * 10_000, 0.2, 0.2, 0.1, 0.0, None, 0.5, streak) for k, streak in enumerate((0, 5, 6, 10, 40))]
    df = spark.createDataFrame(rows, "title_id long, seq long, at_ms long, frame_difference double, motion double, cut double, text_change double, face_change double, luminance double, static_streak long")
    base = 1.6 * (0.2 * 0.15 + 0.2 * 0.25 + 0.1 * 0.35)
    want = [base * max(0.25, 1 - max(0, s - 5) * 0.06) for s in (0, 5, 6, 10, 40)]
    got = [r.importance for r in sequences.importance(df).orderBy("seq").collect()]
    assert got == pytest.approx(want)


def test_spectra_by_a_direct_transform(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").limit(2).collect()
    out = {r.chunk: r for r in QUERIES["p15_audio_spectra"](spark, SF).collect()}
    for r in rows:
        x = [float(v) for v in r.embedding] * 8
        n = len(x)
        w = [v * (0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))) for i, v in enumerate(x)]
        spec = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / n) for i, v in enumerate(w))) for k in range(n // 2 + 1)]
        total = sum(spec)
        centroid = sum(8000 * k / (n // 2) * s for k, s in enumerate(spec)) / total
        flat = math.exp(sum(math.log(s + 1e-10) for s in spec) / len(spec)) / (total / len(spec) + 1e-10)
        zcr = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:])) / (n - 1)
        got = out[r.vec_id]
        assert (got.spectrum_sum, got.centroid) == pytest.approx((total, centroid), rel=1e-4) and (got.flatness, got.zcr) == pytest.approx((flat, zcr), abs=2e-4) and got.n_mfcc == 13


def test_complete_sources(spark):
    coverage = spark.createDataFrame([(1, 0.4), (2, 0.5)], "title_id long, ratio double")
    out = project.mark_complete(coverage, spark.createDataFrame([(1, "subtitle"), (1, "video")], "title_id long, source string"))
    assert sorted((r.title_id, r.ratio, r.complete) for r in out.collect()) == [(1, 1.0, True), (2, 0.5, False)]


def test_request_table_by_loops(spark):
    hour = 3_600_000
    rows = {}
    for r in views.evidence(spark, SF).select("title_id", "seq", "source", "start_ms", "end_ms").collect():
        rows.setdefault(r.title_id, []).append(r)
    want = {}
    for title, items in rows.items():
        of = lambda s: [r for r in items if r.source == s]  # noqa: B023, E731
        for w in of("purchase"):
            lines = sorted((r for r in of("view") if r.start_ms < w.end_ms and r.end_ms >= w.start_ms - 2000), key=lambda r: (r.start_ms, r.seq))[:12]
            newest = lambda s, within, strict: [r.seq for r in sorted((r for r in of(s) if w.start_ms - r.start_ms <= within and (r.start_ms < w.start_ms or not strict and r.start_ms == w.start_ms)), key=lambda r: (-r.start_ms, -r.seq))]  # noqa: B023, E731
            setting = newest("signup", 50 * hour, False)
            want[w.seq] = ([r.seq for r in sorted(lines, key=lambda r: (max(r.start_ms, w.start_ms), r.seq))], setting[0] if setting else None, newest("click", 12 * hour, True)[:3])
    assert {r.seq: (r.dialogue, r.setting, r.actions) for r in QUERIES["p21_request_table"](spark, SF).collect()} == want


def test_align_tracks_by_loops(spark):
    """Groups that share a second cue with all that was merged before them join, also where the last of these does not hold it."""
    from tidemark.plans.alignment import align_tracks

    r = random.Random(7)
    cues = lambda n, first: [(t, first + 100 * t + i, s := r.randrange(0, 4000), s + r.randrange(50, 900), f"x{i}") for t in (1, 2) for i in range(n)]
    primary, secondary = cues(25, 0), cues(18, 1000)
    want = []
    for title in (1, 2):
        left, right = ([c for c in side if c[0] == title] for side in (primary, secondary))
        share = lambda a, b: (min(a[3], b[3]) - max(a[2], b[2])) / min(a[3] - a[2], b[3] - b[2])
        rows, used = [], set()
        for a in left:
            hits = sorted((b for b in right if share(a, b) > 0 and share(a, b) >= 0.25), key=lambda b: (b[2], b[1]))
            used |= {b[1] for b in hits}
            rows.append((min([a[2], *(b[2] for b in hits)]), a[1], max([a[3], *(b[3] for b in hits)]), [a[1]], [b[1] for b in hits]))
        rows += [(b[2], b[1], b[3], [], [b[1]]) for b in right if b[1] not in used]
        groups = []
        for start, _, end, one, two in sorted(rows, key=lambda x: x[:2]):
            if groups and set(groups[-1][3]) & set(two):
                g = groups[-1]
                groups[-1] = (g[0], max(g[1], end), g[2] + one, g[3] + [s for s in two if s not in g[3]])
            else:
                groups.append((start, end, one, two))
        want += [(title, *g) for g in groups]
    schema = "title_id long, seq long, start_ms long, end_ms long, text string"
    out = align_tracks(spark.createDataFrame(primary, schema), spark.createDataFrame(secondary, schema), 500)
    got = sorted((x.title_id, x.start_ms, x.end_ms, list(x.primary), list(x.secondary)) for x in out.collect())
    assert got == sorted(want) and len(got) < 60
