"""Substring dedup by super-k-mer partitioning.

A window is ``width`` = 35 consecutive words. Its minimiser is the least hash
among the ``GRAM``-word grams in it; consecutive windows of a document that
share a minimiser form a super-k-mer, which travels as one packed string to
the minimiser's bucket, where sorting counts its windows exactly. Words that
some repeated window covers are removed.

1. Each document gives its super-k-mers as (minimiser, first window, windows).
   A minimiser that occurs once in the corpus can have no repeated window, so
   counts of minimisers (pre-aggregated) leave only suspects.
2. Documents with suspects give their packed strings. Equal strings are
   counted before the shuffle, so copies of a passage cost one row per task.
3. Buckets expand their strings into windows and count them by sorting; equal
   hashes are compared word by word. A minimiser with more than ``hot``
   different strings is not one task's work: its windows are counted one by
   one as rows (pre-aggregated), dealt by the window's 128-bit digest.
4. Repeated windows go back to the documents, which drop the covered words.

Null and empty texts and texts under ``width`` words lose nothing. Repeated
rows, also with equal or null ids, are documents of their own. Extra columns
stay out of the digest. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, keep, mixed, rolling, small_batches, utf8_words

WIDTH, GRAM = 35, 6
BUCKET_BYTES = 4 << 20


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def super_kmers(h: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimiser and its number of places for each super-k-mer of a document's word hashes.

    Two equal windows of one super-k-mer hold its minimiser at two places, so places count like super-k-mers.
    """
    grams = rolling(h, GRAM)
    least = _sliding_least(grams, width - GRAM + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.append(first, len(least)))
    places = np.ones(len(first), np.int32)
    ordered = np.sort(grams)
    if (ordered[1:] == ordered[:-1]).any():
        for k, (a, n) in enumerate(zip(first, count)):
            places[k] = np.count_nonzero(grams[a : a + n + width - GRAM] == least[a])
    return first, count, least[first], places


def repeated_windows(strings: list[bytes], times: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each packed string, which of its windows occur twice or more in all of them; times: occurrences of each string. Exact."""
    ids: dict[bytes, int] = {}
    split = [s.split(b" ") for s in strings]
    flat = np.array([ids.setdefault(w, len(ids)) for words in split for w in words], np.int64)
    sizes = np.array([len(words) - width + 1 for words in split])
    begins = np.concatenate(([0], np.cumsum([len(words) for words in split])[:-1]))
    at = np.concatenate([b + np.arange(n) for b, n in zip(begins, sizes)])
    weight = np.repeat(np.array(times, np.int64), sizes)
    key = rolling(mixed(flat.astype(np.uint64) + np.uint64(1)), width)[at]
    order = np.argsort(key, kind="stable")
    key, start = key[order], at[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    same = np.flatnonzero(~new)
    if len(same):
        for k in range(0, len(same), 50_000):
            part = same[k : k + 50_000]
            step = np.arange(width)
            if not (flat[start[part][:, None] + step] == flat[start[part - 1][:, None] + step]).all():
                return _by_words(split, times, width)
    group = np.cumsum(new) - 1
    total = np.bincount(group, weight[order])
    flag = np.empty(len(at), bool)
    flag[order] = total[group] > 1
    return np.split(flag, np.cumsum(sizes)[:-1])


def _by_words(split: list[list[bytes]], times: list[int], width: int) -> list[np.ndarray]:
    """The same by the words themselves, for the rare bucket in which two different windows have one hash."""
    seen: dict[tuple[bytes, ...], int] = {}
    for words, n in zip(split, times):
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            seen[w] = seen.get(w, 0) + n
    return [np.array([seen[tuple(words[k : k + width])] > 1 for k in range(len(words) - width + 1)]) for words in split]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def covered(n: int, found: list[tuple[int, int, bytes]], width: int = WIDTH) -> np.ndarray:
    """Which of n words a repeated window covers; found: (first window, windows, packed bits)."""
    edge = np.zeros(n + 1, np.int64)
    for first, count, bits in found:
        on = first + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=count))
        np.add.at(edge, on, 1)
        np.add.at(edge, on + width, -1)
    return np.cumsum(edge[:n]) > 0


def _key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _text_key(text: str | None) -> bytes:
    return _key((text or "").encode("utf-8", "surrogatepass"))


def find_suspects(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Of each row its text's key, n_words and digest; and the different texts that have suspect super-k-mers, with these and the number of copies."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.doc_id, b.text):
                words = utf8_words(text)
                first, count, least, places = super_kmers(hash_words(text.encode("utf-8", "surrogatepass")), width) if len(words) >= width else (np.zeros(0, int),) * 4
                out.append((doc_id, _text_key(text), len(words), _digest(words), least.astype(np.uint64).view(np.int64), first.astype(np.int32), count.astype(np.int32), places.astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "text_key", "n_words", "sha", "least", "first", "count", "places"])

    small_batches(docs.sparkSession)
    schema = "doc_id string, text_key binary, n_words long, sha string, least array<long>, first array<int>, count array<int>, places array<int>"
    marks = keep(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(mark, schema), "substr-marks")
    each = marks.select("text_key", F.explode(F.arrays_zip("least", "first", "count", "places")).alias("m")).select("text_key", "m.*")
    often = each.groupBy("least").agg(F.sum("places").alias("n")).where("n > 1").select("least")
    suspects = each.join(often.hint("merge"), "least").groupBy("text_key").agg(F.collect_set(F.struct("least", "first", "count")).alias("marks"))
    @F.pandas_udf("binary")
    def text_key(text: pd.Series) -> pd.Series:
        return text.map(_text_key)

    # one row of each text: copies are reduced before the shuffle, and the join uses its partitioning
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", text_key("text")).groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return marks.select(F.col("doc_id").cast("long").alias("doc_id"), "text_key", "n_words", "sha"), keep(texts.join(suspects.hint("merge"), "text_key"), "substr-suspects")


def find_repeats(suspects: DataFrame, width: int = WIDTH, hot: int = 2000) -> DataFrame:
    """text_key, found: of each text with repeated windows the array of (first, count, bits)."""
    spark = suspects.sparkSession

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text_key, text, copies, marks in zip(b.text_key, b.text, b.copies, b.marks):
                words = utf8_words(text)
                for m in marks:
                    packed = b" ".join(words[m["first"] : m["first"] + m["count"] + width - 1])
                    out.append((m["least"], _key(packed), packed, text_key, m["first"], m["count"], copies))
            yield pd.DataFrame(out, columns=["least", "key", "packed", "text_key", "first", "count", "copies"])

    packs = keep(suspects.mapInPandas(pack, "least long, key binary, packed binary, text_key binary, first int, count int, copies long"), "substr-packs")
    # equal strings (same minimiser and 128-bit key) become one row with their number before the shuffle
    strings = keep(packs.groupBy("least", "key", "packed").agg(F.sum("copies").alias("times")).withColumn("size", F.octet_length("packed")), "substr-strings")
    many = keep(strings.groupBy("least").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot).select("least"), "substr-hot")
    # a bucket gets about BUCKET_BYTES of strings, however large the corpus is
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 8, (strings.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES)
    schema = "least long, key binary, bits binary"

    def count(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["least", "key"])
        flags = repeated_windows(b.packed.tolist(), b.times.tolist(), width)
        some = np.array([f.any() for f in flags], bool)
        return pd.DataFrame({"least": b.least[some], "key": b.key[some], "bits": [_bits(f) for f, s in zip(flags, some) if s]})

    some_hot = not many.isEmpty()
    cold = strings.join(many.hint("merge"), "least", "left_anti") if some_hot else strings
    found = cold.withColumn("bucket", F.pmod(F.xxhash64("least"), F.lit(buckets))).groupBy("bucket").applyInPandas(count, schema)
    if some_hot:

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for least, key, packed, times in zip(b.least, b.key, b.packed, b.times):
                    words = packed.split(b" ")
                    n = len(words) - width + 1
                    yield pd.DataFrame([(least, key, k, _key(b" ".join(words[k : k + width])), times, n) for k in range(n)], columns=["least", "key", "place", "window", "times", "count"])

        def gather(b: pd.DataFrame) -> pd.DataFrame:
            flags = np.zeros(int(b["count"].iloc[0]), bool)
            flags[b.place.to_numpy()] = True
            return pd.DataFrame({"least": [b.least.iloc[0]], "key": [b.key.iloc[0]], "bits": [_bits(flags)]})

        windows = keep(strings.join(many.hint("merge"), "least", "left_semi").mapInPandas(spread, "least long, key binary, place int, window binary, times long, count int"), "substr-windows")
        twice = windows.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1").select("window")
        found = found.unionByName(windows.join(twice.hint("merge"), "window").groupBy("least", "key").applyInPandas(gather, schema))
    found = keep(found, "substr-found")

    spots = packs.select("least", "key", "text_key", "first", "count").distinct()
    return spots.join(found.hint("merge"), ["least", "key"]).groupBy("text_key").agg(F.collect_list(F.struct("first", "count", "bits")).alias("found"))


def _kept_words(text: str | None, found: object, width: int) -> tuple[list[bytes], list[bytes]]:
    words = utf8_words(text)
    if found is None or isinstance(found, float) or not len(found):
        return words, words
    gone = covered(len(words), [(m["first"], m["count"], m["bits"]) for m in found], width)
    return words, [w for w, g in zip(words, gone) if not g]


def digest_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows, suspects = find_suspects(docs, width)
    found = find_repeats(suspects, width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, f in zip(b.text_key, b.text, b.found):
                words, left = _kept_words(text, f, width)
                out.append((key, len(words) - len(left), _digest(left)))
            yield pd.DataFrame(out, columns=["text_key", "gone", "left_sha"])

    changed = suspects.select("text_key", "text").join(found.hint("merge"), "text_key").mapInPandas(run, "text_key binary, gone long, left_sha string")
    return rows.join(changed.hint("merge"), "text_key", "left").select("doc_id", "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left_sha", "sha").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the words that repeated windows cover taken out of text (the others joined by one space where something went)."""
    names = docs.columns
    _, suspects = find_suspects(docs, width)
    found = find_repeats(suspects, width).withColumnRenamed("text_key", "_text_key").withColumnRenamed("found", "_found")

    @F.pandas_udf("binary")
    def text_key(text: pd.Series) -> pd.Series:
        return text.map(_text_key)

    @F.pandas_udf("string")
    def run(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, f in zip(text, found):
            words, left = _kept_words(t, f, width)
            out.append(t if len(left) == len(words) else b" ".join(left).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    keyed = docs.withColumn("_text_key", text_key(F.coalesce("text", F.lit(""))))
    return keyed.join(found.hint("merge"), "_text_key", "left").withColumn("text", run("text", "_found")).select(*names)
