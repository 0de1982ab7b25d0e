"""The join's plan may change with the number of documents, its result may not."""

import random

from tests.llm.test_operators import ROWS, brute_jaccard, prose, rows_of
from tidemark.llm import jaccard


def test_documents_joined_or_let_through_by_bits(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in ROWS] + [(None, prose(50, 3)), (60, prose(50, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_jaccard(rows, 4, 85)
    for most in (0, 1 << 28):
        monkeypatch.setattr(jaccard, "MOST_FILTER", most)
        assert rows_of(jaccard.join_documents(df), "doc_id", "n_shingles", "component_id") == want


def test_few_counters_cost_no_pair(spark):
    """With 64 counters for all columns rare and frequent ones look alike; links stay the same."""
    words = prose(140, 5).split(" ")
    r = random.Random(6)
    rows = [(i, " ".join(x if r.random() > 0.02 else f"e{i}" for x in words)) for i in range(30)] + [(50 + i, prose(90, 60 + i)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, counts = jaccard.read_sets(df, 4, counters=64)
    assert len(counts) == 64 and counts.sum() == sum(x.n_shingles for x in sets.collect())
    first = jaccard.keep(sets.where("sid is not null").groupBy("sid").agg({"doc_id": "min"}).toDF("sid", "first"), "first")
    many = jaccard.link_sets(df, first, 4, 85, jaccard.read_sets(df, 4)[1])
    few = jaccard.link_sets(df, first, 4, 85, counts)
    group = lambda links: {x.node: x.component for x in jaccard.components(links).collect()}
    assert group(few) == group(many) and group(few)
