"""Trees over records and their byte ranges, against hashlib."""

import hashlib

from pyspark.sql import functions as F

from tests.llm.test_operators import rows_of
from tidemark.llm import warc


def pages(spark, n):
    return spark.createDataFrame([(i, f"http://x/{i}", "body " * (i % 7), "clash") for i in range(n)], "page_id long, url string, html string, digest string")


def test_root_by_hashlib(spark):
    held = warc.manifest(pages(spark, 23), per_file=100)
    rows = sorted(held.collect(), key=lambda r: r.place)
    leaves = held.select("file", "place", warc.leaf(F.col("offset"), F.col("length"), F.col("digest")).alias("digest"))
    root = warc.levels(leaves, 22, fanout=4)[-1].collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = [sha(f"leaf|{r.offset}|{r.length}|{r.digest}") for r in rows]
    while len(level) > 1:
        level = [sha("node|" + "|".join(f"{k}:{h}" for k, h in enumerate(level[a : a + 4], a))) for a in range(0, len(level), 4)]
    assert [r.digest for r in root] == level
    assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]


def test_moved_and_resized_records(spark):
    """Equal bytes at another place of the file, or with another length, are found once the replica states its ranges."""
    held = warc.manifest(pages(spark, 40), per_file=20)
    copy = held.select("file", "place", "digest", F.when((F.col("file") == 1) & (F.col("place") == 7), F.col("offset") + 3).otherwise(F.col("offset")).alias("offset"), F.when((F.col("file") == 0) & (F.col("place") == 2), 1).otherwise(F.col("length")).alias("length"))
    out = warc.audit(held, copy, fanout=4)
    assert rows_of(out, "file", "place") == [(0, 2), (1, 7)] and out.where("digest != replica_digest").count() == 0
    assert warc.audit(held, copy.drop("offset", "length"), fanout=4).count() == 0


def test_null_ids_are_many_files(spark):
    rows = [(None, f"u{k}", "x" * k) for k in range(300)] + [(None, "same", "y")] * 5 + [(3, None, None)]
    held = warc.manifest(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert held.count() == 306 and held.where("file < 0").select("file").distinct().count() > 200
    assert held.groupBy("file", "place").count().where("count > 1").count() == 0
    long = spark.createDataFrame([(1, "u", "z" * 3_000_000)], "page_id long, url string, html string")
    assert warc.manifest(long).first().length > 3_000_000
