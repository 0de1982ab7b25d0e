"""Toxicity: a linear classifier of character n-grams, each scaled by its naive Bayes log-count ratio.

A text's features are the hashed character n-grams (``SHORTEST`` to ``LONGEST``
code points) of its words, lower-cased and set between two blanks; each counts
once. An n-gram that the share a of toxic and b of other labelled documents
hold counts r = log(a / b) instead of 1 (smoothed, so that an n-gram that nobody
holds has 0), and only where a chi-square test finds that a and b differ:

    P(toxic) = sigmoid(bias + sum of v[g] * r[g] over the distinct n-grams g of the text)

Ratios and weights v are learnt from a bounded sample of the labelled documents
(``sample_rows`` smallest seeded hashes of ids); the counts are taken by Spark,
v is fitted by full-batch Adam. Margins are stretched to probabilities by Platt
scaling on halves of the sample that were not learnt from. Scoring covers every
row and the whole of each text.

Null and empty texts have no n-grams and score sigmoid(bias). Null labels and
null ids teach nothing; of rows with one id the text with the least hash is
learnt, and an id that is labelled more than once is toxic if any label says
so. Repeated rows get equal scores. Without labels of both kinds all weights
are zero and every row gets the share of toxic labels (0 without labels).
Columns other than the id and the text are never read; those of the input stay
in the output of ``score``, but for its own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, small_batches

DIMENSIONS = 1 << 19
SHORTEST, LONGEST = 4, 8
SMOOTH = 1.0
#: Least chi-square of an n-gram that counts (0.99 quantile, one degree of freedom).
LEAST_CHI = 6.6
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(64 - DIMENSIONS.bit_length() + 1)
#: Slots of fewer sampled documents, or of a lesser chi-square over the whole sample, are dropped before the fit.
LEAST_ROWS, LEAST_SEEN_CHI = 5, 3.3


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray  # float32[DIMENSIONS]: v times r
    bias: float

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[slots].sum(dtype=np.float64), -30, 30))))


def ngram_slots(text: str | None) -> np.ndarray:
    """Distinct slots of a text's n-grams, ascending. Blanks end words, so an n-gram has them at its ends only."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    keep = np.append(True, ~(blank[1:] & blank[:-1]))  # a run of blanks is one
    points, blank = np.where(blank, 32, points)[keep].astype(np.uint64), blank[keep]
    words = np.cumsum(blank)  # a place's number of blanks up to it
    on = np.zeros(DIMENSIONS, bool)
    h = np.zeros(len(points), np.uint64)
    for n in range(1, min(LONGEST, len(points)) + 1):
        h = h[: len(points) - n + 1] * _STEP + points[n - 1 :]
        if n >= SHORTEST:
            inner = words[n - 2 : len(words) - 1] == words[: len(words) - n + 1]  # no blank but at the ends
            on[(h[inner] * _MIX >> _SHIFT).astype(np.int64)] = True
    return np.flatnonzero(on).astype(np.int32)


def log_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, smooth: float = SMOOTH) -> np.ndarray:
    """Naive Bayes log-count ratio of every slot: how often toxic documents hold it against the others; 0 where neither does."""
    share = n_toxic / (n_toxic + n_other)
    return np.log((toxic + smooth * share) / n_toxic) - np.log((other + smooth * (1 - share)) / n_other)


def chi_square(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Chi-square (one degree of freedom) of each slot against the label; 0 for slots that all or none hold."""
    n, held = n_toxic + n_other, toxic + other
    spread = held * (n - held) * float(n_toxic) * n_other
    return np.divide(n * (toxic * float(n) - held * float(n_toxic)) ** 2, spread, out=np.zeros(len(toxic)), where=spread > 0)


def fit_scaled(index: np.ndarray, sizes: np.ndarray, label: np.ndarray, ratio: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 3e-3) -> ToxicModel:
    """Logistic regression on the scaled features by full-batch Adam. index: the slots of all rows one after the other; sizes: how many each row has."""
    share = float(label.mean()) if len(label) else 0.0
    if not 0 < share < 1:
        return ToxicModel(np.zeros(len(ratio), np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    on = (ratio != 0)[index]
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[on]
    used = np.flatnonzero(ratio)
    at = (np.cumsum(ratio != 0, dtype=np.int32) - 1)[index[on]]
    r = ratio[used]
    v = np.zeros(len(used) + 1)
    v[-1] = np.log(share / (1 - share))
    m, s = np.zeros_like(v), np.zeros_like(v)
    for step in range(1, steps + 1):
        score = v[-1] + np.bincount(doc, (v[:-1] * r)[at], len(sizes))
        wrong = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - label
        g = np.append(np.bincount(at, wrong[doc], len(used)) * r / len(sizes) + decay * v[:-1], wrong.mean())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(len(ratio), np.float32)
    weights[used] = v[:-1] * r
    return ToxicModel(weights, float(v[-1]))


def fit_calibrated(index: np.ndarray, sizes: np.ndarray, label: np.ndarray, toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, least: float = LEAST_CHI, decay: float = 3e-3) -> ToxicModel:
    """The fit of all rows, with margins stretched so that they are probabilities for rows that were not learnt from.

    Each half of the rows is scored by a fit of the other half, with counts that leave the scored half out; a line through
    these margins (Platt scaling) gives stretch and shift. toxic, other: numbers of documents of both kinds with each slot.
    """

    def ratios(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
        return np.where(chi_square(a, b, n_a, n_b) >= least, log_ratios(a, b, n_a, n_b), 0.0)

    if not (n_toxic and n_other):
        return fit_scaled(index, sizes, label, np.zeros(len(toxic)))
    half = np.arange(len(sizes)) % 2 == 0
    of = np.repeat(half, sizes)
    margins = np.zeros(len(sizes))
    for out in (half, ~half):
        entries = of if out is half else ~of
        tox = np.repeat(label[out] == 1, sizes[out])
        a = np.bincount(index[entries][tox], minlength=len(toxic))
        b = np.bincount(index[entries][~tox], minlength=len(toxic))
        n_a = int((label[out] == 1).sum())
        n_b = int(out.sum()) - n_a
        if min(n_toxic - n_a, n_other - n_b) < 1 or not 0 < label[~out].mean() < 1:
            return fit_scaled(index, sizes, label, ratios(toxic, other, n_toxic, n_other), decay=decay)
        part = fit_scaled(index[~entries], sizes[~out], label[~out], ratios(toxic - a, other - b, n_toxic - n_a, n_other - n_b), decay=decay)
        doc = np.repeat(np.arange(int(out.sum())), sizes[out])
        margins[out] = part.bias + np.bincount(doc, part.weights[index[entries]], int(out.sum()))
    line = np.array([1.0, 0.0])
    x = np.column_stack((margins, np.ones(len(margins))))
    for _ in range(50):  # Newton steps of a logistic regression on one number; a small ridge keeps separable margins finite
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (p - label) + 1e-3 * (line - [1.0, 0.0])
        line -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
    stretch = float(np.clip(line[0], 0.5, 5.0))
    model = fit_scaled(index, sizes, label, ratios(toxic, other, n_toxic, n_other), decay=decay)
    return ToxicModel(model.weights * np.float32(stretch), model.bias * stretch + float(line[1]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 10000, seed: int = 11) -> ToxicModel:
    """Learn from at most ``sample_rows`` labelled documents of labels (doc_id, toxic).

    The driver gets the counts of at most ``DIMENSIONS`` slots and one packed row for each document of the sample.
    """
    spark = docs.sparkSession
    rated = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sample = rated.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_rows)
    # at most sample_rows rows of 12 bytes, so it may be broadcast; repeats of an id are reduced before the shuffle
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "toxic": b.toxic, "slots": [ngram_slots(t).astype("<i4").tobytes() for t in b.text]})

    rows = keep(found.mapInPandas(features, "doc_id long, toxic int, slots binary"), "toxic-rows")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, DIMENSIONS), np.int64)
        for b in batches:
            for toxic, slots in zip(b.toxic, b.slots):
                seen[toxic, np.frombuffer(slots, "<i4")] += 1
        slot = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"slot": slot, "toxic": seen[1, slot], "other": seen[0, slot]})

    counted = rows.select("toxic", "slots").mapInPandas(count, "slot long, toxic long, other long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = counted.where(F.col("toxic") + F.col("other") >= LEAST_ROWS).toArrow()
    toxic, other = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    toxic[counts["slot"].to_numpy()] = counts["toxic"].to_numpy()
    other[counts["slot"].to_numpy()] = counts["other"].to_numpy()
    kinds = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = kinds.get(1, 0), kinds.get(0, 0)
    wanted = spark.sparkContext.broadcast(np.packbits(chi_square(toxic, other, n_toxic, n_other) >= LEAST_SEEN_CHI))  # a bit for each slot

    @F.pandas_udf("binary")
    def telling(slots: pd.Series) -> pd.Series:
        on = np.unpackbits(wanted.value).astype(bool)
        return slots.map(lambda x: (s := np.frombuffer(x, "<i4"))[on[s]].tobytes())

    fetched = rows.select("doc_id", "toxic", telling("slots").alias("slots")).toArrow().sort_by("doc_id")
    wanted.destroy()
    forget(rows)
    assert fetched.num_rows <= sample_rows
    packed = fetched["slots"].combine_chunks()
    sizes = np.array(pc.binary_length(packed), np.int64) // 4
    index = np.frombuffer(packed.buffers()[2], "<i4")[: sizes.sum()] if sizes.any() else np.zeros(0, np.int32)
    return fit_calibrated(index, sizes, fetched["toxic"].to_numpy().astype(np.int64), toxic, other, n_toxic, n_other)


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted; every row, every other column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series([m.score(ngram_slots(t)) for t in texts], dtype="float64")

    rated = docs.select(*columns, rate(F.col("text")).alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def rate_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 10000, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted, by a model of these labels."""
    small_batches(docs.sparkSession)
    return score(docs, train(docs, labels, sample_rows), threshold)
