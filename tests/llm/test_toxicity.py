"""The toxicity model against a second implementation, and its accuracy on rows that were not learnt from."""

import math
import random
import re
import zlib

import numpy as np

from tests.llm.test_operators import SCHEMA, TEXTS, prose
from tidemark.llm import queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def plain_slots(text):
    """Hash of every n-gram of every word between two blanks, one by one."""
    out = set()
    for word in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()):
        word = f" {word} "
        for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
            for k in range(len(word) - n + 1):
                h = 0
                for c in word[k : k + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                out.add(h * 0xD6E8FEB86659FD93 % 2**64 >> 64 - 19)
    return sorted(out)


def test_features_by_loops():
    for t in [*TEXTS[:6], *TEXTS[6:], "  a\t\tbcd \x0b efghijklmn ", "İstanbul ǅ ẞ", "a", prose(3000, 5)]:
        assert toxicity.ngram_slots(t).tolist() == plain_slots(t)


def test_ratios_and_chi_square_by_hand():
    toxic, other = np.array([30.0, 10, 0, 0, 100]), np.array([10.0, 90, 4, 0, 900])
    r = toxicity.log_ratios(toxic, other, 100, 900)
    assert np.allclose(r, [math.log((30.1 / 100) / (10.9 / 900)), 0.0, math.log((0.1 / 100) / (4.9 / 900)), 0.0, 0.0], atol=0.01) and abs(r[3]) < 1e-12
    chi = toxicity.chi_square(toxic, other, 100, 900)
    cells = [(30, 4), (70, 96), (10, 36), (890, 864)]  # seen and expected for the first slot
    assert abs(chi[0] - sum((a - b) ** 2 / b for a, b in cells)) < 1e-6 and chi[1] < 1e-9 and chi[3] == chi[4] == 0


def test_scores_by_a_second_implementation(spark):
    r = np.random.default_rng(4)
    model = toxicity.ToxicModel(r.normal(size=toxicity.DIMENSIONS).astype(np.float32) / 20, -0.5)
    df = spark.createDataFrame([(i, t, 9.5, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, score double, `a.b` string")
    out = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    for i, t in enumerate(TEXTS):
        p = 1 / (1 + math.exp(-max(-30, min(30, -0.5 + sum(float(model.weights[k]) for k in plain_slots(t))))))
        assert abs(out[i].score - p) < 1e-6 and out[i].predicted == int(out[i].score >= 0.3) and out[i]["a.b"] == "s"
    assert toxicity.score(df.limit(0), model).collect() == []


def labelled(n, seed=1):
    """Prose, a fifth with one word of a bad stem in it; longer texts are not worse."""
    r, rows = random.Random(seed), []
    for i in range(n):
        toxic = int(r.random() < 0.2)
        words = prose(r.randint(5, 120), 1000 + i).split()
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randint(0, len(words)), r.choice(["vile", "foulmouth", "nasty"]) + r.choice(["", "er", "ish", "!", "ness"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_query_learns_and_leaves_the_held_out_rows_alone(spark, tmp_path):
    rows = labelled(1600)
    extra = [(9001, None), (9002, ""), (9003, "Vile thing"), (None, "no id"), (9001, None)]
    docs = [(i, t, "en", "s", len(t)) for i, t, _ in rows] + [(i, t, "en", None, 0) for i, t in extra]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(tmp_path / "a/documents.parquet"))
    # labels of held-out rows are wrong: they must not matter
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    labels = [(i, 1, 1 - y if held(i) else y) for i, _, y in rows] + [(None, 1, 1), (9001, 1, None), (rows[0][0], None, None)]
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "a/labels.parquet"))
    got = queries.op12_toxicity(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    by = {x.doc_id: x for x in got}
    assert all(x.held_out == held(x.doc_id) for x in got if x.doc_id is not None)
    test = [(by[i], y) for i, _, y in rows if held(i)]
    assert np.mean([x.predicted == y for x, y in test]) > 0.97 and len(test) > 300
    assert by[9003].predicted == 1 and by[9002].score == by[9001].score < 0.3
    spark.createDataFrame(docs, SCHEMA).orderBy("text").repartition(2).write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.createDataFrame([x for x in labels if x[0] is None or not held(x[0])], LABELS).write.parquet(str(tmp_path / "b/labels.parquet"))
    again = {x.doc_id: x.score for x in queries.op12_toxicity(spark, str(tmp_path / "b")).collect()}
    assert all(abs(again[x.doc_id] - x.score) < 1e-9 for x in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for labels, want in ([], 0.0), ([(1, 1, 0), (2, 1, 0)], 0.0), ([(1, 0, 1)], 1.0), ([(7, 0, 1)], 0.0):
        out = toxicity.rate_toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(out) == 2 and all(abs(x.score - want) < 1e-6 for x in out)
    assert toxicity.rate_toxicity(docs.limit(0), spark.createDataFrame([], LABELS)).collect() == []


def test_sample_bound_and_repeated_labels(spark):
    rows = labelled(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(i, 1, 0) for i, _, _ in rows], LABELS)
    once = toxicity.train(docs.dropDuplicates(), spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS))
    twice = toxicity.train(docs, labels)
    assert np.allclose(once.weights, twice.weights, atol=1e-6) and abs(once.bias - twice.bias) < 1e-6
    assert toxicity.train(docs, labels, sample_rows=0).weights.any() == False  # noqa: E712
