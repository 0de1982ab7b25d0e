"""Verdicts against a numpy estimate of least determinant, and counts where hashes clash."""

import random

import numpy as np

from tests.llm.test_operators import SCHEMA, TEXTS, brute_stats, prose, rows_of
from tidemark.llm import rules

FLOOR = np.diag(np.square(rules.FLOORS))


def plain_mcd(x, tries=60, share=0.75):
    """Mean and covariance by concentration steps with exact ranks from random starts, until nothing changes; the least determinant wins."""
    r, best = np.random.default_rng(3), None
    for _ in range(tries):
        some = x[r.choice(len(x), 8, replace=False)]
        m, c = some.mean(0), np.cov(some.T, bias=True) + FLOOR
        for _ in range(60):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            near = x[np.argsort(d, kind="stable")[: int(np.ceil(share * len(x)))]]
            new = near.mean(0), np.cov(near.T, bias=True) * rules.CONSISTENCY + FLOOR
            if np.allclose(new[0], m) and np.allclose(new[1], c):
                break
            m, c = new
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, m, c
    return best


def test_verdicts_against_numpy(spark):
    """Two clusters of rows, so that starts differ; distances near those of exact ranks, verdicts alike."""
    r = random.Random(8)

    def text(i, odd):
        n = r.randrange(60, 90) if odd else r.randrange(100, 400)
        w = prose(n, 7 * i).split(" ")
        return " ".join(x + "%" if odd and r.random() < 0.12 else x for x in w)

    rows = [(i, text(i, i % 5 == 0), ("en", "de")[i % 2], "s", 0) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {x.doc_id: x for x in rules.judge(df).collect()}
    stats = {x.doc_id: x for x in rules.vectors(rules.base_stats(df)).collect()}
    agree = total = 0
    for lang in ("en", "de"):
        ids = [i for i, _, at, *_ in rows if at == lang and not stats[i].base_failed]
        x = np.array([[stats[i][s] for s in rules.STATS] for i in ids])
        det, m, c = plain_mcd(x)
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        assert np.corrcoef(d, [out[i].distance for i in ids])[0, 1] > 0.99
        agree += sum((v <= 20.5) == out[i].kept for v, i in zip(d, ids))
        total += len(ids)
        grp = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, " + ", ".join(f"{s} double" for s in rules.STATS))
        volume = rules.robust_groups(grp).first().volume
        assert abs(2 * volume - det) < 0.3  # bins of 5 % of a distance stand between them
    assert agree >= 0.99 * total


def test_a_bad_start_is_left(spark):
    """Of the starts the one with the least determinant counts: a third of the rows far away does not move the estimate."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(700, 5)) * 0.3, r.normal(size=(300, 5)) * 0.3 + 6])
    df = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, " + ", ".join(f"{s} double" for s in rules.STATS))
    e = rules.robust_groups(df, share=0.6).first()
    assert all(abs(e[f"m{i}"]) < 0.2 for i in range(5))


def test_counts_where_hashes_clash(spark, monkeypatch):
    texts = [*TEXTS, "a b c x y z a b c", "a b c " * 40, " ".join(f"{k % 7} {k % 5}" for k in range(300))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    want = sorted(((i, *brute_stats(t)) for i, t in enumerate(texts)), key=repr)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert rows_of(rules.base_stats(df, most_places=3), *columns) == want  # windows as strings
    monkeypatch.setattr(rules, "_POS", 61)  # three bits of hash
    monkeypatch.setattr(rules, "_POS_MASK", (1 << 61) - 1)
    assert rows_of(rules.base_stats(df), *columns) == want
