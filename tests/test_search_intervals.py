"""Search with places against loops; interval and as-of joins against all pairs, with ranges of any length."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import boundaries, intervals
from tidemark.plans import search

SIGNS = ".,!?;:'\"()[]{}-–—…·‘’ʼ“”"


def plain_match(text, needle):
    """(start, length) by one pass over the characters."""
    out, at, blank = "", [], True
    for i, c in enumerate(text):
        if c in SIGNS:
            continue
        if c.isspace() and c not in "\x1c\x1d\x1e\x1f\x85":
            if not blank:
                out, blank = out + " ", True
                at.append(i)
            continue
        low = c.lower()
        out, blank = out + low, False
        at += [i] * len(low)
    if out.endswith(" "):
        out, at = out[:-1], at[:-1]
    k = out.find(needle)
    if k < 0:
        return None
    end = at[k + len(needle)] if k + len(needle) < len(at) else len(text)
    return at[k], max(1, end - at[k])


TEXTS = ["Hello, world.", "  out -- of   (milk)!  ", "“Don’t” go", "a . b", "İstanbul éte", "the. the", "", "...", None, "x", "We are OUT OF　MILK now", "ＦＵＬＬ width", "日本語の 台詞", "th-th, the end…", "😀 smile, please"]
NEEDLES = ["hello world", "Out of milk", "don't", "a b", "the", "x", "日本", "smile please", "ｅｎｄ", "i", "w", "th", "o"]


def test_matches_by_loops(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for n in NEEDLES:
        needle = search.needle_of(n)
        got = {r.i: tuple(r.m) if r.m else None for r in df.select("i", search.find_match(F.col("text"), needle).alias("m")).collect()}
        assert got == {i: None if t is None else plain_match(t, needle) for i, t in enumerate(TEXTS)}, n
    r = random.Random(4)
    texts = ["".join(r.choice("ab .,-’AB\t") for _ in range(r.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for needle in ("a", "ab", "a b", "b a a"):
        got = {x.i: tuple(x.m) if x.m else None for x in df.select("i", search.find_match(F.col("text"), needle).alias("m")).collect()}
        assert got == {i: plain_match(t, needle) for i, t in enumerate(texts)}
    assert search.needle_of(" ,. ") == "" and search.needle_of("ＡＢ​c’s") == "abcs"


BEATS = [
    (1, 1, "dialogue", "Jiyeon Kim", "우유가 없어.", [("ko", "우유가 없어."), ("en", "We're out of milk.")]), (1, 2, "action", None, "She opens the refrigerator; no milk.", None),
    (1, 3, "dialogue", "BEN", "Milk? Out, of... milk!", []), (1, 4, "sound", None, "MILK bottle breaks", None), (1, 5, "transition", None, None, None), (2, 1, "dialogue", None, "nothing", [("en", "nothing"), ("fr", "du lait, milk")]),
]
SCHEMA = "title_id long, place int, type string, name string, text string, variants array<struct<language: string, text: string>>"


def test_scopes_languages_and_limit(spark):
    df = spark.createDataFrame(BEATS, SCHEMA).repartition(3)
    hits = lambda *a, **k: [(r.title_id, r.place, r.language, r.at, r.length) for r in search.search(df, *a, **k).collect()]
    assert hits("out of milk", language="en") == [(1, 1, "en", 6, 12), (1, 3, None, 6, 16)]
    assert hits("OUT OF MILK") == [(1, 3, None, 6, 16)]
    assert hits("out of milk", all_languages=True) == [(1, 1, "en", 6, 12), (1, 3, None, 6, 16)]
    assert hits("우유", all_languages=True) == hits("우유", language="ko") == [(1, 1, "ko", 0, 2)] and hits("우유", language="en") == []
    assert hits("milk", scope="action") == [(1, 2, None, 31, 5), (1, 4, None, 0, 4)]
    assert hits("milk", scope="dialogue") == [(1, 3, None, 0, 5)]
    assert hits("milk", scope="dialogue", all_languages=True) == [(1, 1, "en", 13, 5), (1, 3, None, 0, 5), (2, 1, "fr", 9, 4)]
    assert hits("jiyeon-KIM", scope="speaker") == [] and hits("JIYEON", scope="speaker", language="en") == [(1, 1, "en", 0, 0)]
    assert hits("   ") == [] and hits("!?", scope="speaker") == [] and [h[:2] for h in hits("milk", limit=2)] == [(1, 2), (1, 3)]
    assert search.search(df.drop("variants"), "milk", "dialogue").select("at").first().at == 0 and search.search(df.limit(0), "milk").collect() == []


def pairs_of(a, b, closed):
    out = []
    for t, i, s, e in a:
        for u, j, q, f in b:
            if t == u and s is not None and q is not None:
                e_, f_ = s if e is None else e, q if f is None else f
                if q < e_ and (f_ >= s if closed else s < f_):
                    out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("closed", [False, True])
def test_overlaps_by_all_pairs(spark, closed):
    r = random.Random(6)

    def rows(n):
        out = []
        for i in range(n):
            s = r.randint(-5_000, 200_000)
            out.append((r.randint(0, 1), i, None if i % 37 == 0 else s, None if i % 11 == 0 else s + r.choice([-3, 0, 1, 50, 100, 700, 10_000, 150_000, 10**9])))
        return out

    a, b = rows(150), rows(150)
    left, right = spark.createDataFrame(a, "title_id int, seq int, start_ms long, end_ms long"), spark.createDataFrame(b, "title_id int, r_seq int, r_start long, r_end long")
    want = pairs_of(a, b, closed)
    for bucket in (100, 999, 10**7):
        assert sorted((x.seq, x.r_seq) for x in intervals.overlap_join(left, right, bucket, closed=closed).select("seq", "r_seq").collect()) == want
    hit = {i for i, _ in want}
    assert sorted(x.seq for x in intervals.overlap_join(left, right, 100, closed=closed, how="left_semi").collect()) == sorted(hit)
    assert sorted(x.seq for x in intervals.overlap_join(left, right, 100, closed=closed, how="left_anti").collect()) == sorted(i for _, i, *_ in a if i not in hit)
    assert intervals.overlap_join(left.limit(0), right, 100).collect() == [] == intervals.overlap_join(left, right.limit(0), 100).collect()


def test_a_long_range_is_a_few_rows(spark):
    """A million buckets long on either side: two nodes for each level in use, not one row for each bucket."""
    long = spark.createDataFrame([(1, 0, 7, 1_000_000_007)], "title_id int, seq int, start_ms long, end_ms long")
    short = spark.range(2000).select(F.lit(1).alias("title_id"), F.col("id").alias("r_seq"), (F.col("id") * 1_000_000).alias("r_start"), (F.col("id") * 1_000_000 + 900).alias("r_end"))
    levels = F.lit((1 << 20) | 1).cast("long")
    assert intervals._nodes(long, "start_ms", "end_ms", 1000, levels, True).count() <= 4 and intervals._nodes(long, "start_ms", "end_ms", 1000, F.lit((1 << 62) - 1).cast("long"), True).count() <= 90
    assert intervals.overlap_join(long, short, 1000).count() == 1001
    turned = intervals.overlap_join(short.toDF("title_id", "seq", "start_ms", "end_ms"), long.toDF("title_id", "r_seq", "r_start", "r_end"), 1000)
    assert turned.count() == 1001


def test_as_of_by_chunks(spark):
    """One title, chunks without samples, ties, rows without a time: as the last row at or before by a loop."""
    r = random.Random(2)
    samples = [(r.choice([1, 1, 1, 2]), i, r.randint(-500, 500) * 10 if i % 29 else None, f"v{i}") for i in range(200)] + [(3, 900, 5, None)]
    asked = [(r.choice([1, 1, 2, 3, 4]), i, r.randint(-600, 2000) * 10 if i % 31 else None) for i in range(300)]
    left, right = spark.createDataFrame(asked, "title_id int, q int, at_ms long"), spark.createDataFrame(samples, "title_id int, seq int, at_ms long, v string").repartition(3)
    want = {}
    for t, q, at in asked:
        held = [(x, s, v) for u, s, x, v in samples if u == t and x is not None and at is not None and x <= at]
        want[q] = (max(held)[1:] if held else (None, None)) if not held or max(held, key=lambda h: h[:2])[2] else (max(held, key=lambda h: h[:2])[1], None)
    for chunk in (50, 1000, 86_400_000):
        got = {x.q: (x.r_seq, x.r_v) for x in intervals.as_of(left, right, ["seq", "v"], chunk_ms=chunk).collect()}
        assert got == want


def test_scene_split_by_chunks(spark):
    r = random.Random(9)
    events = [(r.choice([1, 1, 1, 2, 3]), i, None if i % 41 == 0 else r.randint(-300, 3000)) for i in range(400)]
    cuts = sorted({(r.choice([1, 1, 2]), r.randint(-200, 3000)) for _ in range(60)})
    df, marks = spark.createDataFrame(events, "title_id int, seq int, start_ms long").repartition(3), spark.createDataFrame(cuts, "title_id int, at_ms long")
    want = {i: 0 if s is None else sum(u == t and at <= s for u, at in cuts) for t, i, s in events}
    for chunk in (7, 500, 86_400_000):
        out = boundaries.split_scenes(df, marks, chunk)
        assert out.columns == ["title_id", "seq", "start_ms", "scene"] and {x.seq: x.scene for x in out.collect()} == want


def test_sounds_overlap_windows(spark):
    from tidemark.plans.requests import sounds_in_window

    r = random.Random(1)
    windows = [(1, i, 100 * i, 100 * i + r.randint(0, 300)) for i in range(30)]
    sounds = [(1, i, s, None if i % 9 == 0 else s + r.randint(0, 400)) for i, s in enumerate(r.randint(-200, 3000) for _ in range(250))]
    got = sorted(map(tuple, sounds_in_window(spark.createDataFrame(windows, "title_id int, seq int, start_ms long, end_ms long"), spark.createDataFrame(sounds, "title_id int, r_seq int, r_start long, r_end long"), 150).collect()))
    want = []
    for _, w, a, b in windows:
        inside = sorted((s, i) for _, i, s, e in sounds if s < b and (s if e is None else e) >= a)[:12]
        want += [(w, i, min(b, max(a, s))) for s, i in inside]
    assert got == sorted(want) and max(sum(x[0] == w for x in want) for w in range(30)) == 12


def test_cues_without_length(spark):
    """They have no share of an overlap: no pair, or a strength that is no number where points are asked for, as 0 / 0 in SQL."""
    from tidemark.operators.joins import align_pairs

    schema = "title_id int, seq long, start_ms long, end_ms long, text string"
    a = spark.createDataFrame([(1, 1, 0, 100, "a"), (1, 2, 50, 50, "b")], schema)
    b = spark.createDataFrame([(1, 11, 20, 90, "c"), (1, 12, 30, 30, "d")], schema)
    right = b.selectExpr("title_id", "seq as r_seq", "start_ms as r_start", "end_ms as r_end")
    assert [(x.seq, x.r_seq, x.strength) for x in align_pairs(a, right, 40).collect()] == [(1, 11, 1.0)]
    got = {(x.seq, x.r_seq): x.strength for x in align_pairs(a, right, 40, points=True).collect()}
    assert set(got) == {(1, 11), (1, 12), (2, 11)} and got[1, 11] == 1.0 and got[1, 12] != got[1, 12] and got[2, 11] != got[2, 11]


def test_tracks_with_cues_without_length(spark):
    from tidemark.plans.alignment import align_tracks

    schema = "title_id int, seq long, start_ms long, end_ms long, text string"
    a = spark.createDataFrame([(1, 1, 0, 100, "a"), (1, 2, 50, 50, "b")], schema)
    b = spark.createDataFrame([(1, 11, 20, 90, "c"), (1, 12, 30, 30, "d")], schema)
    assert sorted((x.primary, x.secondary) for x in align_tracks(a, b, 40).collect()) == [([], [12]), ([1], [11]), ([2], [])]
