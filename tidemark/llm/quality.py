"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered (0 toxic, 1 poor, 2 good). One vector of hashed-text weights
is shared by all grades; ordered thresholds cut the latent score s = w.x:

    P(grade > k) = sigmoid(s - theta_k),    theta_0 < theta_1

A text's features are the hashes of its distinct words (letters only, lower
case) and of a few words that describe its form (symbols stuck to words, share
of capitals, share of repeated words). Weights are fitted by full-batch Adam on
a bounded, documented sample of the labelled rows (``sample_rows`` smallest
seeded hashes); scoring covers every row and the whole of each text.

Null or empty texts have no features but the form word ``form:empty``; null
ratings are left out of the fit. With no usable labels nothing can be learnt:
all weights are zero and every row is kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, small_batches, words_of

DIMENSIONS = 1 << 18
_EDGE = re.compile(r"[\W\d_]+$|^[\W\d_]+")
_CACHE = 200_000


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # float32[DIMENSIONS]
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % DIMENSIONS


class Featurizer:
    """Distinct hashed features of a text; remembers a bounded number of words."""

    def __init__(self) -> None:
        self.seen: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int]:
        core = _EDGE.sub("", word)
        edge = word[len(core) :] if core and word.startswith(core) else ("" if core else word)
        form = _slot("edge:" + edge[:4]) if len(edge) > 1 or not core else -1
        out = (_slot(core.lower()) if core else -1, form)
        if len(self.seen) >= _CACHE:
            self.seen.clear()
        self.seen[word] = out
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.array([_slot("form:empty")])
        distinct = set(words)
        seen, slots = self.seen, set()
        for w in distinct:
            slots.update(seen.get(w) or self._word(w))
        slots.discard(-1)
        n, letters = len(words), max(1, len(text))
        capitals = sum(map(str.isupper, words)) / n
        marked = sum(map(text.count, "!#$%&*|<>")) / letters
        slots.add(_slot(f"marks:{min(12, int(200 * marked) if marked < 0.03 else 6 + int(20 * marked))}"))
        slots.add(_slot(f"capitals:{int(capitals * 5)}"))
        slots.add(_slot(f"distinct:{int(10 * len(distinct) / n ** 0.8)}"))
        slots.add(_slot(f"length:{min(12, n.bit_length())}"))
        slots.add(_slot(f"word:{min(12, letters // n)}"))
        return np.fromiter(slots, np.int64, len(slots))


def fit(rows: list[tuple[np.ndarray, int]], grades: int = 3, steps: int = 200, rate: float = 0.05, decay: float = 1e-4, min_docs: int = 8) -> OrdinalModel:
    """Cumulative-link fit by penalised maximum likelihood. rows: (feature slots, grade); slots of fewer than min_docs rows keep weight 0."""
    sizes = np.array([len(x) for x, _ in rows], np.int64)
    index = np.concatenate([np.asarray(x, np.int32) for x, _ in rows]) if rows else np.zeros(0, np.int32)
    return fit_packed(index, sizes, np.array([g for _, g in rows], np.int64), grades, steps, rate, decay, min_docs)


def fit_packed(index: np.ndarray, sizes: np.ndarray, grade: np.ndarray, grades: int = 3, steps: int = 200, rate: float = 0.05, decay: float = 1e-4, min_docs: int = 8) -> OrdinalModel:
    """The same from compressed rows: all slots one after the other, and how many each row has."""
    theta = np.linspace(-1.0, 1.0, grades - 1) if grades > 2 else np.zeros(grades - 1)
    w = np.zeros(DIMENSIONS)
    if len(np.unique(grade)) < 2:
        return OrdinalModel(w.astype(np.float32), theta - 30)
    often = np.bincount(index, minlength=DIMENSIONS) >= min_docs
    place = np.cumsum(often, dtype=np.int32) - 1  # of each frequent slot among them
    used = np.flatnonzero(often)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[often[index]]
    index = place[index[often[index]]]
    v, m, s = (np.zeros(len(used) + grades - 1) for _ in range(3))
    v[len(used) :] = theta
    upper, lower = np.minimum(grade, grades - 2), np.maximum(grade - 1, 0)
    at = np.arange(len(sizes))
    for step in range(1, steps + 1):
        score = np.bincount(doc, v[index], len(sizes))
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - np.sort(v[len(used) :])[None, :], -30, 30)))
        # P(grade = g) = tail[g-1] - tail[g], with tail[-1] = 1 and tail[last] = 0
        hi = np.where(grade > 0, tail[at, lower], 1.0)
        lo = np.where(grade < grades - 1, tail[at, upper], 0.0)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_score = d_hi - d_lo
        g = np.empty_like(v)
        g[: len(used)] = -np.bincount(index, d_score[doc], len(used)) / len(sizes) + decay * v[: len(used)]
        for k in range(grades - 1):
            g[len(used) + k] = (d_hi * ((lower == k) & (grade > 0)) - d_lo * ((upper == k) & (grade < grades - 1))).sum() / len(sizes)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    w[used] = v[: len(used)]
    return OrdinalModel(w.astype(np.float32), np.sort(v[len(used) :]))


def grade_col(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null when there is no rating."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2).cast("int")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12000, seed: int = 7, min_docs: int = 8) -> OrdinalModel:
    """Fit on at most ``sample_rows`` labelled documents: those with the smallest seeded hash of their id, of rows with one id the text with the least hash.

    Document frequencies are counted by Spark, and slots of fewer than ``min_docs`` rows are dropped there. The driver gets one
    packed row for each document of the sample, of at most ``DIMENSIONS`` slots in four bytes each.
    """
    rated = labels.select("doc_id", grade_col(F.col("quality"), F.col("toxic")).alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_rows)
    # the sample has at most sample_rows rows of 12 bytes, so it may be broadcast; repeats of an id are reduced before the shuffle
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Featurizer()
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "grade": b.grade, "slots": [np.sort(make(t)).astype("<i4").tobytes() for t in b.text]})

    rows = keep(found.mapInPandas(features, "doc_id long, grade int, slots binary"), "ordinal-rows")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(DIMENSIONS, np.int64)
        for b in batches:
            for slots in b.slots:
                seen[np.frombuffer(slots, "<i4")] += 1
        slot = np.flatnonzero(seen)
        yield pd.DataFrame({"slot": slot, "n": seen[slot]})

    often = np.zeros(DIMENSIONS, bool)
    counted = rows.select("slots").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    often[counted.where(F.col("n") >= min_docs).select("slot").toArrow()["slot"].to_numpy()] = True  # at most DIMENSIONS slots, in one job
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(often))  # a bit for each slot

    @F.pandas_udf("binary")
    def frequent(slots: pd.Series) -> pd.Series:
        on = np.unpackbits(shared.value).astype(bool)
        return slots.map(lambda x: (s := np.frombuffer(x, "<i4"))[on[s]].tobytes())

    fetched = rows.select("doc_id", "grade", frequent("slots").alias("slots")).toArrow().sort_by("doc_id")
    shared.destroy()
    forget(rows)
    assert fetched.num_rows <= sample_rows
    slots = fetched["slots"].to_pylist()
    sizes = np.array([len(s) // 4 for s in slots], np.int64)
    return fit_packed(np.frombuffer(b"".join(slots), "<i4"), sizes, fetched["grade"].to_numpy().astype(np.int64), min_docs=1)


def score(docs: DataFrame, model: OrdinalModel, min_tail: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail_probability (of the best grade) and kept; every row, every column."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights
    columns = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "kept")]
    docs = docs.select(*columns)

    @F.pandas_udf("struct<expected_grade: double, tail_probability: double>")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, make = shared.value, Featurizer()
        for texts in batches:
            s = np.array([float(m.weights[make(t)].sum()) for t in texts])
            tails = m.tails(s)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_probability": tails[:, -1]})

    rated = docs.withColumn("_rate", rate(F.col("text")))
    return rated.select(*columns, "_rate.expected_grade", "_rate.tail_probability", (F.col("_rate.tail_probability") >= min_tail).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 12000, min_tail: float = 0.5) -> DataFrame:
    small_batches(docs.sparkSession)
    return score(docs, train(docs, labels, sample_rows), min_tail)
