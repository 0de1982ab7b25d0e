"""Connected components by alternating large-star and small-star rounds.

Every round is two partial aggregations and two joins on the node; a hub with
very many neighbours is pre-aggregated before the shuffle and its side of the
join can be split by Spark, so no node is gathered into one task. Edges of
each round go to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Null ends and loops are ignored, repeated edges count once; no edges give no rows.
    """
    a, b = F.col(a), F.col(b)
    now = keep(edges.where((a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("u").alias("node"), F.col("v").alias("nb")).unionAll(now.select(F.col("v").alias("node"), F.col("u").alias("nb")))
        least = both.groupBy("node").agg(F.least(F.min("nb"), F.col("node")).alias("m"))
        large = both.where("nb > node").join(least.hint("merge"), "node").select(F.col("nb").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        after = keep(small, "edges")
        new = _mark(after)
        forget(now)
        now, same, mark = after, new == mark, new
        if same:
            break
    tops = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops)
