"""Ordinal confidence: unknown < low < medium < high."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("unknown", "low", "medium", "high")


def confidence_rank(level: Column) -> Column:
    """0..3; anything else counts as unknown."""
    out = F.lit(0)
    for i, name in enumerate(LEVELS):
        out = F.when(level == name, i).otherwise(out)
    return out


def from_rank(rank: Column) -> Column:
    """The level of a rank, rounded half up and clamped."""
    at = F.greatest(F.lit(0), F.least(F.lit(3), F.floor(rank + 0.5))).cast("int")
    return F.element_at(F.array(*map(F.lit, LEVELS)), at + 1)


def from_score(score: Column, strong: Column | bool = False) -> Column:
    """A level from a score: .75, .45 and 0 are the steps; at most medium unless the evidence is strong."""
    strong = strong if isinstance(strong, Column) else F.lit(strong)
    finite = score.isNotNull() & ~F.isnan(score.cast("double")) & (F.abs(score.cast("double")) != float("inf"))
    rank = F.when(~finite, 0).when(score >= 0.75, 3).when(score >= 0.45, 2).when(score > 0, 1).otherwise(0)
    return from_rank(F.when(strong, rank).otherwise(F.least(rank, F.lit(2))))


def derive(level: Column, inferred: Column | bool = True) -> Column:
    """Inference costs one step."""
    inferred = inferred if isinstance(inferred, Column) else F.lit(inferred)
    return from_rank(confidence_rank(level) - inferred.cast("int"))


def corroborate(level: Column, source: Column) -> Column:
    """Aggregate: the best level, one step more with two distinct sources, high at most; unknown for none."""
    best = F.max(confidence_rank(level))
    more = (F.min(source) != F.max(source)).cast("int")
    return from_rank(F.coalesce(F.least(F.lit(3), best + F.coalesce(more, F.lit(0))), F.lit(0)))


def max_confidence(level: Column) -> Column:
    return from_rank(F.coalesce(F.max(confidence_rank(level)), F.lit(0)))


def min_confidence(level: Column) -> Column:
    return from_rank(F.coalesce(F.min(confidence_rank(level)), F.lit(0)))


def describe(level: Column) -> Column:
    return F.when(level.isin("high", "medium", "low"), F.concat(F.initcap(level), F.lit(" confidence"))).otherwise("Confidence unknown")
