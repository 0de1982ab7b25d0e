"""Each stage's rows, texts included, against brute force."""

import collections
import random

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_jaccard, brute_repeats, prose, rows_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def corpus():
    r = random.Random(12)
    passage = prose(50, 9000)
    rows = []
    for i in range(40):
        words = prose(60 + i, 9001 + i).split(" ")
        if i % 4 == 0:
            words[20:20] = passage.split(" ")
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        if i % 5 == 0:
            near = list(words)
            near[r.randrange(len(near))] = "swapped"
            rows.append((500 + i, " ".join(near), "de", f"s{i % 2}", 0))
    return rows + [(900, None, "en", None, 0), (901, "", None, "s1", 0), (902, "short text", "en", None, 3)]


def test_near_copies(spark):
    rows = corpus()
    groups = {i: c for i, _, c in brute_jaccard([(x[0], x[1]) for x in rows], 5, 80)}
    want = sorted((x for x in rows if groups[x[0]] == x[0]), key=repr)
    assert rows_of(corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), ""), *COLUMNS) == want
    assert len(want) < len(rows) - 6


def test_substrings(spark):
    rows = corpus()
    out = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    seen = collections.Counter(tuple((t or "").split()[k : k + 35]) for _, t, *_ in rows for k in range(len((t or "").split()) - 34))
    want = []
    for i, t, lang, source, _ in rows:
        words = (t or "").split()
        gone = {j for k in range(len(words) - 34) if seen[tuple(words[k : k + 35])] > 1 for j in range(k, k + 35)}
        text = " ".join(w for k, w in enumerate(words) if k not in gone) if gone else t
        want.append((i, text, lang, source, None if text is None else len(text)))
    assert rows_of(out, *COLUMNS) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in brute_repeats([x[1] for x in rows], 35)) > 8


def test_mix_repeats_whole_rows(spark):
    rows = [(i, prose(20 + i, i), "en", "a" if i < 30 else None, i) for i in range(40)] + [(99, None, "en", "a", 0)]
    out = collections.Counter(map(tuple, (tuple(r[c] for c in COLUMNS) for r in corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "").collect())))
    assert set(out) <= set(rows) and max(out.values()) <= 3 and not any(r[1] is None for r in out)
    size = lambda r: len(r[1].split())
    total = {s: sum(size(r) for r in rows if r[1] and r[3] == s) for s in ("a", None)}
    # two sources weigh 5 and 2; the second may stand for three times its size at most
    level = sum(total.values()) / 7
    target = {"a": 5 * level, None: 2 * level}
    if target[None] > 3 * total[None]:
        target = {None: 3 * total[None], "a": sum(total.values()) - 3 * total[None]}
    for s, t in target.items():
        assert abs(sum(size(r) * n for r, n in out.items() if r[3] == s) - t) <= max(size(r) for r in rows if r[1])
