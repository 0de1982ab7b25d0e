"""Mixing sources to target weights by capped water-filling.

Each source's share of the total follows its weight, but no target may exceed
``max_epochs`` times the source's size; what a capped source cannot take is
shared by the others in proportion to their weights, until none is above.

A document is taken floor(r) whole times (r = target / size of its source);
the fractional repetition takes a seeded part of the source's documents: they
stand in the order of a seeded hash, and those are taken whose middle word
lies below the fraction of the source's words. So a source misses its target
by half a document at most. Prefix sums go through hash ranges (source, first
bits of the hash), so a source with most of all rows is never one task.

Null sources form one source (last); null and empty texts have size 0 and are
never taken; equal rows are told apart only by their order, so reruns agree.
Very long texts are taken whole or not at all. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
#: Columns of the result and of the work; columns of docs with these names are left out.
_ADDED = ("size", "source_size", "target", "taken", "_at", "_tie", "_range", "_inside", "_source", "_part", "before")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float = EPOCHS) -> DataFrame:
    """sources(source, source_size, weight) with target. Each round shares what is left among the sources below their cap."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    capped: Column = cap <= 0
    level = 0.0
    while True:
        now = sources.agg(F.sum(F.when(capped, cap)).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.sum(F.when(capped, 1).otherwise(0)).alias("n")).first()
        if not now.open:
            break
        level = (total - (now.full or 0.0)) / now.open
        above = capped | (F.col("weight") * level >= cap)
        if sources.agg(F.sum(F.when(above, 1).otherwise(0))).first()[0] == now.n:
            break
        capped = above
    return sources.withColumn("target", F.when(capped, cap).otherwise(F.col("weight") * level))


def measure(docs: DataFrame, seed: int = 11) -> DataFrame:
    """docs with size and, for the order, _at (seeded hash), _tie (text hash) and _range (first bits of _at)."""
    own = [c for c in docs.columns if c not in _ADDED]
    text = F.xxhash64("text")
    sized = docs.select(*own, n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "source", text).alias("_at"), text.alias("_tie"))
    # ranges follow the order of the hash, so their number changes the tasks and not the result
    bits = max(6, (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    return sized.withColumn("_range", F.shiftright("_at", 64 - bits))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = EPOCHS, seed: int = 11) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes, repeats counted)."""
    return place(measure(docs, seed), weights, max_epochs)


def mix_sizes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = EPOCHS, seed: int = 11) -> DataFrame:
    """The same without texts: the words of each are counted once, then written without it."""
    narrow = measure(docs.select("doc_id", "source", "text"), seed).drop("text")
    return place(keep(narrow, "mix-sized"), weights, max_epochs)


def place(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = EPOCHS) -> DataFrame:
    """What the mix takes of each measured row."""
    own = [c for c in sized.columns if c not in _ADDED]
    parts = keep(sized.groupBy("source", "_range").agg(F.sum("size").alias("words")), "mix-parts")
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    # a row for each source
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = keep(sizes.select("source", "source_size", weight.cast("double").alias("weight")), "mix-sources")
    targets = water_fill(sources, max_epochs).select(F.col("source").alias("_source"), "source_size", "target")
    before = F.sum("words").over(Window.partitionBy("source").orderBy("_range")) - F.col("words")
    plan = parts.withColumn("before", before).join(targets.hint("merge"), F.col("source").eqNullSafe(F.col("_source"))).select(F.col("source").alias("_source"), F.col("_range").alias("_part"), "before", "source_size", "target")
    inside = F.sum("size").over(Window.partitionBy("source", "_range").orderBy("_at", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = sized.withColumn("_inside", inside).join(plan.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_part")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (F.col("before") + F.col("_inside") + F.col("size") / 2) < (rate - whole) * F.col("source_size")
    return placed.select(*own, "size", "source_size", "target", (F.col("size") * (whole + extra.cast("long"))).cast("long").alias("taken"))


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as often as the mix takes them; rows without words go."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return mixed.where("taken > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).select(*columns)
