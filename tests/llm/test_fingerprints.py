"""Likenesses against plain loops, and the order of documents at every number of ranges."""

import random

from pyspark.sql import functions as F

from tests.llm.test_operators import ROWS, prose
from tidemark.llm import fingerprints
from tidemark.llm.common import words_of


def grams_of(text):
    w = words_of(text)
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])


def test_likenesses_against_loops(spark):
    rows = [(i, prose(30 + 11 * i, i) if i % 4 else prose(90, 4)) for i in range(12)] + [(50, None), (51, "a b"), (52, prose(6000, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = [(i, t or "") for i, t in sorted(rows, reverse=True)]
    edited = {}
    for k, (i, t) in enumerate(ordered):
        m = len(t) // 3
        edited[i] = t[: len(t) - m] + ordered[(k + 1) % len(ordered)][1][:m]
    every = sorted({g for t in [*(t for _, t in ordered), *edited.values()] for g in grams_of(t)})
    full = spark.createDataFrame([(" ".join(g), *g) for g in every if len(g) == 5], "name string, " + ", ".join(f"c{k} string" for k in range(5)))
    short = spark.createDataFrame([(" ".join(g),) for g in every if len(g) < 5], "name string")
    value = {r.name: r.h >> 28 for r in full.select("name", F.xxhash64(*[f"c{k}" for k in range(5)]).alias("h")).collect() + short.select("name", F.xxhash64("name").alias("h")).collect()}

    def prints(text):
        h = [value[" ".join(g)] for g in grams_of(text)]
        chosen = {max((k for k in range(a, min(a + 8, len(h))) if h[k] == min(h[a : a + 8])), default=None) for a in range(max(1, len(h) - 7))} - {None}
        return {h[k] for k in chosen}

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = {r.doc_id: r for r in fingerprints.fingerprint_edits(df).collect()}
    for k, (i, t) in enumerate(ordered):
        assert abs(out[i].near_edited - like(prints(t), prints(edited[i]))) < 1e-12
        assert abs(out[i].near_next - like(prints(t), prints(ordered[(k + 1) % len(ordered)][1]))) < 1e-12


def test_any_number_of_ranges_gives_one_order(spark):
    """Null ids and an id with a third of the rows each are dealt into many parts, in one order."""
    r = random.Random(5)
    rows = [(None if k % 3 == 0 else 77 if k % 3 == 1 else r.randrange(10**6), prose(4, k)) for k in range(600)] + [(i, t) for i, t, *_ in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {}
    for n in (1, 7, 64, 3000):
        out = fingerprints.with_next(df, n).where("not copy")
        found[n] = sorted(((x.doc_id, x.text, x.next_text or "") for x in out.collect()), key=repr)
        if n == 64:
            assert out.groupBy("part").count().agg(F.max("count")).first()[0] < 40
    assert all(x == found[1] for x in found.values())
    tie = {x.text: x.tie for x in fingerprints.with_next(df, 1).where("not copy").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), tie[x[1]]))
    want = sorted(((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)), key=repr)
    assert found[1] == want


def test_many_shuffle_partitions(spark):
    df = spark.createDataFrame([(i, prose(20, i)) for i in range(40)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    few = sorted(map(tuple, fingerprints.fingerprint_edits(df).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2000")
        assert sorted(map(tuple, fingerprints.fingerprint_edits(df).collect())) == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
