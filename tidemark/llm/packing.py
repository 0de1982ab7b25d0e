"""Best-fit packing by hierarchical residual packing.

Documents become token ids in Arrow batches; each is cut into pieces of at
most ``limit`` tokens. Partitions pack their pieces best-fit (longest first),
nearly full bins are final, and underfull bins travel on as items: fewer tasks
pack them again, round by round, until a round joins nothing. A task of any
round gets at most about ``items_per_task`` items, so no task holds all bins.

Null and empty texts are one piece that holds the end id alone. Repeated rows,
also with equal or null ids, are packed each for itself. Extra columns are left
out. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches

LIMIT, END_ID = 4096, 1
_RUNS_KEPT = 700_000
# Characters for which the tokenizer's split is plain: runs of these letters, single digits, runs of these marks (no apostrophe).
_LETTERS, _MARKS, _BLANK = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~", r"\x20\x09-\x0d"
_ODD = re.compile(rf"[^{_LETTERS}{_MARKS}{_BLANK}0-9]")
_RUNS = re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
#: The same, but a word that has any other character is one run.
_RUNS_OR_WORDS = re.compile(rf"(?<![^{_BLANK}])[^{_BLANK}]*[^{_LETTERS}{_MARKS}{_BLANK}0-9][^{_BLANK}]*|{_RUNS.pattern}")


class Encoder:
    """Ids of whole texts as little-endian bytes.

    The tokenizer's rules never join anything over a blank and split plain text
    into runs of letters or marks; each run is encoded once and remembered (a
    bounded number of them). New runs are encoded many at a time and cut after
    the ids that end a run. Texts with special tokens go to the tokenizer whole.
    Tests compare with the tokenizer's ids of whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.runs: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        probe = "Ab.c1!? 22 d"
        self.plain = b"".join(self._ids(_RUNS.findall(probe.lower()))) == self._ids([probe])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        plain = [r for r in new if not _ODD.search(r)]
        for k in range(0, len(plain), 1000):
            part = plain[k : k + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            self.runs.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends)] if len(ends) == len(part) else self._ids(part)))
        other = [r for r in new if _ODD.search(r)]
        self.runs.update(zip(other, self._ids(other)))

    def _split(self, text: str) -> list[str]:
        return _RUNS_OR_WORDS.findall(text) if _ODD.search(text) else _RUNS.findall(text.lower())

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        whole = [not self.plain or "<|" in (t or "") for t in texts]
        for k in range(0, len(texts), 64):
            part = [t or "" for t in texts[k : k + 64]]
            split = [[] if w else self._split(t) for t, w in zip(part, whole[k:])]
            distinct = set().union(*split)
            new = distinct.difference(self.runs)
            if len(self.runs) + len(new) > _RUNS_KEPT:
                self.runs, new = {}, distinct
            if new:
                self._learn(list(new))
            for text, runs, w in zip(part, split, whole[k:]):
                yield self._ids([text])[0] if w else b"".join(map(self.runs.__getitem__, runs))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker process keeps its encoder, and what that remembers, from task to task."""
    return Encoder(path)


def vocabulary_path(name: str) -> str:
    """A file of the installed public tokenizers by name, or a path as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 of each piece of each row."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, uid = encoder(vocabulary_path(tokenizer)), TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.doc_id, encode(b.text.tolist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((uid, doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    uid += 1
            yield pd.DataFrame(rows, columns=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    # ids travel as strings: pandas would make floats of numbers with nulls
    pieces = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, "uid long, doc_id string, piece int, start long, length long, ids_crc32 long")
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


def best_fit(lengths: list[int], limit: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; items come longest first. A bit of ``free`` says that some bin has just that much room."""
    room: list[list[int]] = [[] for _ in range(limit + 1)]
    fill: list[int] = []
    free, bins, offsets = 0, [], []
    for n in lengths:
        fits = free >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            k = room[left].pop()
            if not room[left]:
                free ^= 1 << left
        else:
            k, left = len(fill), limit
            fill.append(0)
        bins.append(k)
        offsets.append(fill[k])
        fill[k] += n
        room[left - n].append(k)
        free |= 1 << (left - n)
    return bins, offsets


def _round(items: DataFrame, number: int, tasks: int, limit: int) -> DataFrame:
    """(uid, bin, offset, filled): each task packs what it gets. Sorted input makes a repeated task give the same."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [b for b in batches]
        if not found:
            return
        b = pd.concat(found).sort_values(["length", "uid"], ascending=[False, True])
        bins, offsets = best_fit(b.length.tolist(), limit)
        bins = np.array(bins, np.int64)
        filled = np.bincount(bins, b.length.to_numpy()).astype(np.int64) if len(bins) else bins
        base = (number << 56) | (TaskContext.get().partitionId() << 32)
        yield pd.DataFrame({"uid": b.uid.to_numpy(), "bin": base + bins, "offset": np.array(offsets, np.int64), "filled": filled[bins]})

    return items.select("uid", "length").repartition(tasks, "uid").mapInPandas(pack, "uid long, bin long, offset long, filled long")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT, end_id: int = END_ID, slack: int = 8, items_per_task: int = 100_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece; bins with at most ``slack`` free tokens are final at once."""
    small_batches(docs.sparkSession)
    pieces = keep(token_pieces(docs, tokenizer, limit, end_id), "pieces")
    items = pieces
    left, number, maps = pieces.count(), 1, []
    tasks = max(1, -(-left // items_per_task))
    while left and number < 64:
        packed = keep(_round(items, number, tasks, limit), "bins")
        maps.append(packed)
        under = packed.where((F.col("offset") == 0) & (F.col("filled") < limit - slack)).select(F.col("bin").alias("uid"), F.col("filled").alias("length"))
        now = under.count()
        if now < 2 or number > 1 and (tasks == 1 or now >= left):
            break
        items, left, number = under, now, number + 1
        tasks = max(-(-now // items_per_task), tasks // 8, 1)
    if not maps:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = maps[0].select("uid", "bin", "offset")
    for later in maps[1:]:
        step = later.select(F.col("uid").alias("bin"), F.col("bin").alias("into"), F.col("offset").alias("shift"))
        out = out.join(step.hint("merge"), "bin", "left").select("uid", F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return pieces.join(out.hint("merge"), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
