"""Periodic run detection by a dictionary of basic factors.

A run is a stretch of consecutive words in which words one period apart are
equal, at least ``least`` words and two periods long, that no neighbour extends.

1. The dictionary names every factor of 2^k words: names of level k + 1 are the
   ranks of pairs of names of level k. A factor that occurs once gets no name
   and ends there, so ordinary text has a few short levels.
2. On each level, successive occurrences of one name at most half the factor's
   length apart are as far apart as its least period: arithmetic progressions.
   Each proposes its difference, and its members' distances to the heads of
   those before and after, within twice the factor's length, as periods.
3. Every proposal is extended to both sides, by factors of falling length, and
   equal stretches are one: the least period of a stretch is that of the run.

Each text is one row's work: n log n numbers for a text whose factors all repeat,
and about n for others. Null and empty texts have no words and no runs;
repeated rows get equal results; extra columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, words_of

LEAST = 12
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def basic_factors(ids: np.ndarray) -> list[np.ndarray]:
    """Names of all factors of 1, 2, 4, ... words by their place; factors that occur once have -1. Ends where nothing repeats."""
    levels, name = [], ids.astype(np.int64)
    while len(name):
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        fresh = np.append(True, ranked[1:] != ranked[:-1])
        size = np.diff(np.append(np.flatnonzero(fresh), len(ranked)))
        rank = np.where(np.repeat(size, size) > 1, np.cumsum(fresh) - 1, -1)
        rank[ranked < 0] = -1
        name = np.empty_like(rank)
        name[order] = rank
        if (name < 0).all():
            break
        levels.append(name)
        step = 1 << (len(levels) - 1)
        left, right = name[: max(0, len(name) - step)], name[step:]
        name = np.where((left >= 0) & (right >= 0), left * (int(name.max()) + 1) + right, -1)
    return levels


def proposals(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) such that every run has its period proposed at one of its places.

    Take a run of period q, a level of h words with h <= q <= 2h, and its pair of occurrences q apart. In one progression,
    q is its difference. Else both can be moved left together, within the run, until one of them is the first of its
    progression. Between progressions of one name lie more than h/2 words, so the other is at most three progressions away.
    """
    places, periods = [], []
    for k in range(max(0, (least // 2).bit_length() - 1), len(levels)):
        name, h = levels[k], 1 << k
        at = np.argsort(name, kind="stable")
        at = at[np.searchsorted(name[at], 0) :]
        gap, same = at[1:] - at[:-1], name[at[1:]] == name[at[:-1]]
        inside = same & (2 * gap <= h)  # the least period of the factor
        chain = np.cumsum(np.append(True, ~inside)) - 1 if len(at) else at
        heads = at[np.append(True, ~inside)] if len(at) else at
        x, d = [at[:-1][inside]], [gap[inside]]
        for t in (1, 2, 3):
            other = np.minimum(chain + t, len(heads) - 1)
            d.append(heads[other] - at)
            on = (chain + t < len(heads)) & (name[heads[other]] == name[at]) & (d[-1] <= 2 * h)
            x.append(at[on])
            d[-1] = d[-1][on]
            other = np.maximum(chain - t, 0)
            d.append(at - heads[other])
            on = (chain >= t) & (name[heads[other]] == name[at]) & (d[-1] <= 2 * h)
            x.append(heads[other][on])
            d[-1] = d[-1][on]
        place, period = np.concatenate(x), np.concatenate(d)
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        first = np.append(True, (period[1:] != period[:-1]) | (place[1:] - place[:-1] > 1))[: len(place)]  # neighbours are one stretch
        places.append(place[first])
        periods.append(period[first])
    return np.concatenate(places) if places else np.zeros(0, np.int64), np.concatenate(periods) if periods else np.zeros(0, np.int64)


def extend(levels: list[np.ndarray], x: np.ndarray, period: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ends (start, end) of the whole stretch around word x that repeats at distance period."""
    up, down = x.copy(), x.copy()
    for k in range(len(levels) - 1, -1, -1):
        name, step, most = levels[k], 1 << k, len(levels[k])
        todo = np.arange(len(x))
        while len(todo):  # more than two rounds only on the highest level
            a, b = up[todo], up[todo] + period[todo]
            inside = b < most
            same = inside & (name[np.where(inside, a, 0)] == name[np.where(inside, b, 0)]) & (name[np.where(inside, a, 0)] >= 0)
            todo = todo[same]
            up[todo] += step
        todo = np.arange(len(x))
        while len(todo):
            a, b = down[todo] - step, down[todo] - step + period[todo]
            inside = (a >= 0) & (b < most)
            same = inside & (name[np.where(inside, a, 0)] == name[np.where(inside, b, 0)]) & (name[np.where(inside, a, 0)] >= 0)
            todo = todo[same]
            down[todo] -= step
    return down, up + period


def find_runs(words: list[str], least: int = LEAST) -> np.ndarray:
    """All runs as rows (start, length, period), by start and then period."""
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    levels = basic_factors(ids)
    x, period = proposals(levels, least)
    start, end = extend(levels, x, period, len(words))
    length = end - start
    on = length >= np.maximum(least, 2 * period)
    found = np.unique(np.column_stack((start[on], length[on], period[on])), axis=0)
    # equal stretches follow each other with rising periods
    first = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[: len(found)]
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def planted(words: list[str], doc_id: str | None) -> list[str]:
    """The query's rewriting of some texts, told by their ids, so that they end in a period; a null id changes nothing."""
    h, n = zlib.crc32((doc_id or "").encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def summary(words: list[str], runs: np.ndarray) -> tuple:
    """Number of runs, the longest (ties: least start, then period), digests of all runs and of the text without their repeats."""
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edges)[:-1] > 0
    left = " ".join(w for w, g in zip(words, gone.tolist()) if not g)
    top = [None] * 4
    if len(runs):
        s, n, p = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        top = [s, n, p, 1000 * n // p]
    return (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest())


def run_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, length, period) of every run of every text; numbers count words from 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find_runs(words_of(t), least) for t in b.text]
            runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            yield pd.DataFrame({"doc_id": np.repeat(b.doc_id.to_numpy(object), [len(f) for f in found]), "start": runs[:, 0], "length": runs[:, 1], "period": runs[:, 2]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, start long, length long, period long")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def detect_runs(docs: DataFrame, least: int = LEAST, plant: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_runs, the longest run, digests of all runs and of the collapsed text."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.doc_id, b.text):
                words = planted(words_of(text), doc_id) if plant else words_of(text)
                out.append((doc_id, *summary(words, find_runs(words, least))))
            yield pd.DataFrame(out, columns=names, dtype=object)

    # ids travel as strings: pandas would make floats of numbers with nulls
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, " + SCHEMA)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
