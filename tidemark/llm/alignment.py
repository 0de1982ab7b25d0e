"""Cross-tokenizer alignment with an identity-map fast path.

Space + text is encoded by tokenizer A (byte-level BPE), the text by tokenizer B
(sentence pieces, which add the space). Byte offsets where tokens of both end
cut the two sequences into groups; two tokens link when their bytes overlap.

1. Before all else a table maps every A id to the B id with the same bytes.
2. One pass over the texts writes, for each document, its digest, the A ids that
   it holds linked to their mapped B id (one-to-one groups are nearly always
   such) and, apart from these, its irregular pairs.
3. How many documents hold a mapped link is counted in one vector as long as
   the vocabulary for each task; only irregular pairs are shuffled and counted.
   A pair that more than 1 / ``HOT`` of all irregular entries hold is one of at
   most ``HOT`` such pairs: these counts are broadcast, so no pair's entries meet in
   one task. Other pairs are joined with their counts by shuffle.
4. Links are then valued by these counts: vectors of the mapped counts and of
   each A id's highest count (both as long as the vocabulary) are broadcast.

Null and empty texts, and texts whose tokens' joined bytes are not space + text
(what a normalizer changes, or U+2581 in the text), have no tokens: zeros and an
empty digest. Repeated rows, also with equal or null ids, count each for itself.
Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, small_batches
from .packing import vocabulary_path

HOT = 1 << 16
_PART = 64
_SHIFT = 32
_LONG_RUN, _LONG_BLANK = 500, re.compile(r"\s{500}")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character in a byte-level vocabulary: printable ones stand for themselves, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers with their tokens' bytes, and the identity map from A ids to B ids (-1: no such B id)."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            self.ranked = self._by_rank(json.load(f))
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            value = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            self.bytes_b.append(bytes([int(value[1], 16)]) if value else piece.replace("\u2581", " ").encode())
        self.long_a, self.long_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        ids: dict[bytes, int] = {}
        for i, x in enumerate(self.bytes_b):
            ids[x] = i  # of a piece and a byte token with the same bytes either may stand; the last is taken
        for i, x in enumerate(self.bytes_b):
            if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i):
                ids[x] = i  # a piece goes before a byte token
        self.same = np.array([ids.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)

    @staticmethod
    def _by_rank(described: dict):
        """The same encoding by ranks, which takes a fifth of the time; None if the file's ids or rules are not those of ranks."""
        import public_tokenizers
        import tiktoken

        model, split, alphabet = described["model"], described.get("pre_tokenizer") or {}, byte_alphabet()
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids, single = model["vocab"], len(byte_alphabet())
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not described.get("normalizer") and model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
        if not plain or any(ids.get(m) != single + k for k, m in enumerate(joined)) or sorted(ids.get(c, -1) for c in alphabet) != list(range(single)):
            return None
        ranks = {bytes(map(alphabet.__getitem__, m)): i for m, i in ids.items() if i < single + len(joined)}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        """A's ids; texts with very long runs, in which ranks take long, go to the tokenizer itself."""
        odd = [self.ranked is None or max(map(len, t.split()), default=0) >= _LONG_RUN or _LONG_BLANK.search(t) is not None for t in texts]
        slow = iter(self.a.encode_batch_fast([t for t, o in zip(texts, odd) if o], add_special_tokens=False) if any(odd) else ())
        return [next(slow).ids if o else self.ranked.encode_ordinary(t) for t, o in zip(texts, odd)]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B of each text; empty where the joined bytes of either differ from space + text."""
        none = np.zeros(0, np.int64)
        some = [t for t in texts if t]
        both = zip(self._ids_a([" " + t for t in some]), self.b.encode(some, num_threads=1)) if some else iter(())
        for text in texts:
            if not text:
                yield none, none
                continue
            a, b = next(both)
            want = (" " + text).encode("utf-8", "surrogatepass")
            exact = b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want
            yield (np.array(a, np.int64), np.array(b, np.int64)) if exact else (none, none)

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions in a and in b of each linked pair, and how many tokens of either are in the groups up to each cut.

        The ends of both cut the bytes into stretches: each lies in one token of either, and each linked pair has just one.
        """
        end_a, end_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        mark = np.zeros(int(end_a[-1]) + 1, np.int8)
        mark[end_a] = 1
        mark[end_b] += 2
        kind = mark[np.flatnonzero(mark)]
        of_a, of_b = kind & 1, kind >> 1
        in_a, in_b = np.cumsum(of_a, dtype=np.int64) - of_a, np.cumsum(of_b, dtype=np.int64) - of_b
        cut = kind == 3
        return in_a, in_b, in_a[cut] + 1, in_b[cut] + 1


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """A worker process keeps its tokenizers from task to task."""
    return Aligner(path_a, path_b)


@functools.lru_cache(maxsize=4)
def _numerals(size: int, end: str) -> np.ndarray:
    return np.array([f"{i}{end}" for i in range(size)], object)


def group_text(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, size_a: int, size_b: int) -> str:
    """Groups as a1,a2|b1;a3|b2,b3: every id with the sign after it, put at its place, then joined. size_a, size_b: the vocabularies' sizes."""
    out = np.empty(len(a) + len(b), object)
    many_a, many_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    at_a = np.arange(len(a)) + np.repeat(cut_b - many_b, many_a)
    at_b = np.arange(len(b)) + np.repeat(cut_a, many_b)
    out[at_a] = _numerals(size_a, ",")[a]
    out[at_b] = _numerals(size_b, ",")[b]
    out[at_a[cut_a - 1]] = _numerals(size_a, "|")[a[cut_a - 1]]
    out[at_b[cut_b - 1]] = _numerals(size_b, ";")[b[cut_b - 1]]
    return "".join(out.tolist())[:-1]


def align_texts(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """For each row: row (a number of its own), doc_id, sizes and digest, and its links: ids and times of mapped ones, packed; keys (A id, B id) and times of others.

    A link of an A id with its mapped B id counts as mapped in whatever group it stands.
    """
    path_a, path_b = vocabulary_path(tokenizer_a), vocabulary_path(tokenizer_b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = aligner(path_a, path_b)
        for batch in batches:
            for k in range(0, len(batch), _PART):
                part, out = batch.iloc[k : k + _PART], []
                for doc_id, (a, b) in zip(part.doc_id, tools.encode(list(part.text))):
                    if not len(a):
                        out.append((doc_id, 0, 0, 0, 0, "", b"", b"", [], []))
                        continue
                    in_a, in_b, cut_a, cut_b = tools.links(a, b)
                    digest = hashlib.sha256(group_text(a, b, cut_a, cut_b, len(tools.bytes_a), len(tools.bytes_b)).encode()).hexdigest()
                    left, right = a[in_a], b[in_b]
                    mapped = tools.same[left] == right
                    ids, times = np.unique(left[mapped], return_counts=True)
                    pairs, many = np.unique((left[~mapped] << _SHIFT) + right[~mapped], return_counts=True)
                    out.append((doc_id, len(a), len(b), len(cut_a), len(in_a), digest, ids.astype("<i4").tobytes(), times.astype("<i4").tobytes(), pairs, many))
                yield pd.DataFrame(out, columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids", "times", "pairs", "many"])

    # ids travel as strings: pandas would make floats of numbers with nulls
    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids binary, times binary, pairs array<long>, many array<int>"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)
    return keep(rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c.split()[0]) for c in schema.split(", ")[1:]]), "aligned")


def mapped_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """In how many documents each A id is linked with its mapped B id: a vector for each task, summed by Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            for ids in b.ids:
                seen[np.frombuffer(ids, "<i4")] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"a": at, "n": seen[at]})

    found = aligned.select("ids").mapInPandas(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()  # at most size rows
    out = np.zeros(size, np.int64)
    out[found["a"].to_numpy()] = found["n"].to_numpy()
    return out


def pair_counts(aligned: DataFrame, mapped: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(pair, n) of all irregular pairs, written; and each A id's highest count, mapped links included."""
    counts = keep(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    best = mapped.copy()
    top = counts.groupBy(F.shiftright("pair", _SHIFT).alias("a")).agg(F.max("n").alias("n")).toArrow()  # at most one row for each A id
    a, n = top["a"].to_numpy(), top["n"].to_numpy()
    best[a] = np.maximum(best[a], n)
    return counts, best


def align(docs: DataFrame, tokenizer_a: str = "byte_bpe_50k.json", tokenizer_b: str = "piece_bpe_32k.model", hot: int = HOT) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    aligned = align_texts(docs, tokenizer_a, tokenizer_b)
    mapped = mapped_counts(aligned, len(aligner(vocabulary_path(tokenizer_a), vocabulary_path(tokenizer_b)).same))
    counts, best = pair_counts(aligned, mapped)
    total = counts.agg(F.sum("n")).first()[0] or 0
    # pairs with more than total / hot entries: fewer than hot of them, whatever the data
    often = counts.where(F.col("n") * hot > total).toArrow().sort_by("pair")
    keys, times = often["pair"].to_numpy(), often["n"].to_numpy()
    shared = spark.sparkContext.broadcast((mapped, best, keys, times))

    @F.pandas_udf("struct<n_best: long, count_sum: long, pairs: array<long>, many: array<int>>")
    def value(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        one, top, keys, times = shared.value
        for ids, n_times, pairs, many in frames:
            out = []
            for i, t, p, m in zip(ids, n_times, pairs, many):
                i, t = np.frombuffer(i, "<i4"), np.frombuffer(t, "<i4").astype(np.int64)
                p, m = np.asarray(p, np.int64), np.asarray(m, np.int64)
                at = np.minimum(np.searchsorted(keys, p), max(0, len(keys) - 1))
                known = keys[at] == p if len(keys) else np.zeros(len(p), bool)
                n = times[at[known]]
                n_best = t[one[i] == top[i]].sum() + m[known][n == top[p[known] >> _SHIFT]].sum()
                out.append((n_best, (t * one[i]).sum() + (m[known] * n).sum(), p[~known], m[~known].astype(np.int32)))
            yield pd.DataFrame(out, columns=["n_best", "count_sum", "pairs", "many"])

    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    valued = keep(aligned.select("row", *names, value("ids", "times", "pairs", "many").alias("v")).select("row", *names, "v.*"), "valued")
    entry = valued.select("row", F.explode(F.arrays_zip("pairs", "many")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.many").cast("long").alias("many"))
    # a rare pair's highest count of its A id travels with its count
    rare = counts.where(F.col("n") * hot <= total)

    @F.pandas_udf("long")
    def top_of(a: pd.Series) -> pd.Series:
        return pd.Series(shared.value[1][a.to_numpy()])

    rare = rare.select("pair", "n", (top_of(F.shiftright("pair", _SHIFT)) == F.col("n")).alias("is_best"))
    more = entry.join(rare.hint("merge"), "pair").groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("many")).otherwise(0)).alias("more_best"), F.sum(F.col("many") * F.col("n")).alias("more_sum"))
    more = keep(more, "rare-values")
    out = valued.select("row", *names, "n_best", "count_sum").join(more.hint("merge"), "row", "left")
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    out = keep(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256"), "alignment")
    for done in (aligned, counts, valued, more):  # the result is written
        forget(done)
    return out
