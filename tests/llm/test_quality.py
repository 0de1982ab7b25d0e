"""The classifier's scores against a second implementation, and its sample under repeats."""

import math
import random
import re
import zlib

import numpy as np

from tests.llm.test_operators import TEXTS, prose
from tidemark.llm import quality


def slot(x):
    return zlib.crc32(x.encode()) % quality.DIMENSIONS


def plain_features(text):
    """Features by the module's description, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return {slot("form:empty")}
    out = set()
    for w in words:
        inner = re.search(r"[^\W\d_](?:.*[^\W\d_])?", w, re.S)
        core = inner[0] if inner else ""
        edge = w if not core else w[len(core) :] if w.startswith(core) else ""
        if core:
            out.add(slot(core.lower()))
        if not core or len(edge) > 1:
            out.add(slot("edge:" + edge[:4]))
    n = len(words)
    marks = sum(c in "!#$%&*|<>" for c in text) / len(text)
    out.add(slot(f"marks:{min(12, int(200 * marks) if marks < 0.03 else 6 + int(20 * marks))}"))
    out.add(slot(f"capitals:{int(5 * sum(w.isupper() for w in words) / n)}"))
    out.add(slot(f"distinct:{int(10 * len(set(words)) / n**0.8)}"))
    out.add(slot(f"length:{min(12, n.bit_length())}"))
    out.add(slot(f"word:{min(12, len(text) // n)}"))
    return out


TEXTS = [*TEXTS, "don't (stop) 3x!! ###", prose(20_000, 8)]


def test_scores_by_a_second_implementation(spark):
    r = np.random.default_rng(2)
    model = quality.OrdinalModel(r.normal(size=quality.DIMENSIONS).astype(np.float32) / 4, np.array([-1.5, 0.75]))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = {x.doc_id: x for x in quality.score(df, model).collect()}
    for i, t in enumerate(TEXTS):
        s = sum(float(model.weights[k]) for k in plain_features(t))
        over = [1 / (1 + math.exp(theta - s)) for theta in (-1.5, 0.75)]
        # expected grade: 0 p0 + 1 p1 + 2 p2
        grade = (over[0] - over[1]) + 2 * over[1]
        assert abs(out[i].expected_grade - grade) < 1e-4 and abs(out[i].tail_probability - over[1]) < 1e-4 and out[i].kept == (out[i].tail_probability >= 0.5)


def test_training_is_the_fit_of_the_sample(spark):
    """Train gives the model that a fit of the same rows gives; repeated and null ids and null ratings change nothing."""
    docs = [(i, prose(40, i) + (" vile rotten" if i % 3 == 0 else " fine" if i % 3 == 1 else " %% ##")) for i in range(90)]
    labels = [(i, int(i % 3 == 1), int(i % 3 == 0)) for i in range(90)]
    want = quality.fit([(np.array(sorted(plain_features(t))), {0: 0, 1: 2, 2: 1}[i % 3]) for i, t in docs])
    extra = [docs[4]] * 50 + [(None, "x"), (4000, None)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rated = spark.createDataFrame(labels + [labels[4]] * 9 + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality.train(frame(docs + extra), rated)
    assert np.allclose(got.weights, want.weights, atol=1e-5) and np.allclose(got.thresholds, want.thresholds, atol=1e-5)
    small = quality.train(frame(docs), rated, sample_rows=30)
    assert (small.weights != 0).any() and not np.allclose(small.weights, got.weights)


def test_one_text_of_each_id(spark):
    """Of unlike texts under one labelled id one is learnt from, the same at every run."""
    rows = [(1, prose(30, k)) for k in range(40)] + [(2, "a b"), (3, "c d")]
    random.Random(1).shuffle(rows)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    models = [quality.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels, min_docs=1) for n in (1, 5)]
    assert (models[0].weights == models[1].weights).all() and 0 < (models[0].weights != 0).sum() < 60
