"""Runs of periodic words against loops over every period and place."""

import collections
import functools
import hashlib
import itertools
import math
import random
import zlib

from tests.llm.test_operators import SCHEMA, TEXTS, prose
from tidemark.llm import queries, runs
from tidemark.llm.common import words_of


@functools.cache
def _plain_runs(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > at and end - at + q >= max(least, 2 * q):
                found.setdefault((at, end - at + q), q)  # periods rise, so the least stays
            at = max(end, at + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_runs(words, least):
    return _plain_runs(tuple(words), least)


def found_runs(words, least=runs.LEAST):
    return [tuple(r) for r in runs.find_runs(list(words), least).tolist()]


def test_all_short_words():
    for n in range(13):
        for word in itertools.product("ab", repeat=n):
            assert found_runs(word, 2) == plain_runs(word, 2)


def test_nested_and_crossing_periods():
    r = random.Random(3)
    for _ in range(1500):
        root = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(1, 30))]
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(root))
            root[k:k] = root[max(0, k - r.randint(1, 8)) : k] * r.randint(1, 4)
        word = (root * r.randint(1, 5))[: r.randint(1, 200)]
        least = r.choice([2, 3, 5, 8, 12])
        assert found_runs(word, least) == plain_runs(word, least), (word, least)
    # two progressions of one factor, every distance between them a period
    assert found_runs("bcbcbcbcbcbcbcbcbbcbcbcbcbcbcbcbcb", 3) == plain_runs("bcbcbcbcbcbcbcbcbbcbcbcbcbcbcbcbcb", 3)
    assert found_runs("aaaabaaaabaaaabaaaabaaaabaaaabaaaababaaaabaaaabaaaabaaaab") == plain_runs("aaaabaaaabaaaabaaaabaaaabaaaabaaaababaaaabaaaabaaaabaaaab", 12)
    short, long = "a", "ab"
    while len(long) < 1000:
        short, long = long, long + short
    assert found_runs(long) == plain_runs(long, 12)


def test_very_long_texts():
    assert found_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    assert found_runs(["a", "b", "c"] * 50_000 + [str(i % 5000) for i in range(100_000)]) == [(0, 150_000, 3), (150_000, 100_000, 5000)]
    assert found_runs(list(map(str, range(100_000)))) == []


CASES = [*TEXTS, "a b " * 6, "a b " * 5 + "a", prose(20, 1) + (" " + prose(7, 2)) * 3 + " end", "x " * 12 + prose(5, 3) + " y z" * 6 + " y", "q" + " q" * 11 + " r" * 12, prose(400, 4) * 2]


def test_query_against_loops(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(CASES)] * 2 + [(-7, "k " * 30), (2**62, prose(90, 9)), (None, "k l " * 9), (None, None)] + [(i, prose(40 + i % 60, i)) for i in range(100, 200)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 5) for i, t in rows], SCHEMA + ", start int").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter(tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect())
    want, n_planted = collections.Counter(), 0
    for i, t in rows:
        words = words_of(t)
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            n_planted += 1
        found = plain_runs(words, 12)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + m for s, m, q in found)]
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(kept))]
        want[(i, len(found), *(top or (None, None, None)), math.floor(1000 * top[1] / top[2]) if top else None, *digest)] += 1
    assert not (got - want) and not (want - got) and n_planted >= 10
    spans = runs.run_spans(df)
    assert collections.Counter(tuple(r) for r in spans.collect()) == collections.Counter((i, *r) for i, t in rows for r in plain_runs(words_of(t), 12))
    assert runs.detect_runs(df.limit(0)).collect() == [] and runs.run_spans(df.limit(0)).collect() == []
