"""The pipeline's stages on small tables: what each keeps, and what the last packs."""

import collections

import pytest

import corpus_pipeline
from tests.llm.test_operators import ROWS, SCHEMA, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rows = ROWS + [(100 + i, prose(80, 100 + i), "en", f"s{i % 3}", 0) for i in range(60)] + [(200 + i, prose(60, 300 + i) + " vile rotten", "en", "s0", 0) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(60)] + [(200 + i, 1, 1) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, folder), name)
        assert docs.columns == columns
        ids.append(collections.Counter(r.doc_id for r in docs.collect()))
    quality, near, cut, mixed = ids
    assert not any(i in quality for i in range(200, 230)) and all(quality[100 + i] for i in range(60))
    assert near[0] == 1 and not near[1] and not near[2]
    assert cut == near
    assert set(mixed) <= set(cut) and max(mixed.values()) <= 3


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
    assert out.groupby("sequence_id").length.sum().max() <= 4096


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
