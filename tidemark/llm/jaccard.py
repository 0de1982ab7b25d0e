"""N-gram Jaccard join by a blocked sparse matrix product.

Rows of the incidence matrix are the distinct n-gram sets of the documents
(equal sets are one row), columns are n-grams. The product of the matrix with
its transpose counts overlaps; it is never formed whole:

1. Columns are ordered from rare to frequent by a table of counts of fixed size
   (``SKETCH`` counters or more; a coarse count only costs time, never a pair). By the
   size-derived bound |x & y| >= t / (1 + t) * (|x| + |y|), rows that link share
   one of their first |x| - ceil(t |x|) + 1 columns, and the places of a shared
   column bound their overlap. Entries outside these prefixes are not multiplied.
2. In each column every row is first paired with one pivot, the row in which the
   column stands first. Found links give components; after that only
   pairs of rows in different components remain and all of these are tested.
   So a large group of near copies costs a star of pairs and not its square, and
   no link between different components is lost.
3. Overlaps of the remaining pairs are summed over ``BLOCKS`` ranges of columns,
   so a very long document's set is never one row's work.

Null and empty texts have no n-grams and link with nothing; texts with fewer
than n words have one, all their words. Rows with null ids take part; a
component's id is its least non-null doc_id. Repeated rows are equal sets.
Extra columns stay out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hash_words, keep, mixed, rolling, small_batches
from .components import components

#: Least and largest number of counters of column frequencies: about SKETCH_ROWS counters for each row between them.
SKETCH, SKETCH_ROWS, MOST_SKETCH = 1 << 20, 8, 1 << 22
BLOCKS = 8
#: Bits for each wanted document, and the largest table of bits that is broadcast (32 MB); beyond it documents are joined.
FILTER_BITS, MOST_FILTER = 16, 1 << 28
_SLICES = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEEN = 200_000


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text, A-Z lower-cased."""
    h = hash_words((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not len(h):
        return h
    grams = np.sort(rolling(h, n) if len(h) >= n else mixed(rolling(h, len(h)) ^ np.uint64(len(h))))
    return grams[np.concatenate(([True], grams[1:] != grams[:-1]))]


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class _Once:
    """Says for each key whether a task sees it for the first time; forgets after a bounded number, which only repeats work."""

    def __init__(self) -> None:
        self.keys: set[int] = set()

    def __call__(self, key: int) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= _SEEN:
            self.keys.clear()
        self.keys.add(key)
        return True


def read_sets(docs: DataFrame, n: int, counters: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, key, sid) of every row, and the counters of column frequencies (each task counts a set once)."""
    size = counters or 1 << (min(MOST_SKETCH, max(SKETCH, SKETCH_ROWS * docs.count())) - 1).bit_length()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, counts = _Once(), np.zeros(size, np.int32)
        for b in batches:
            out = []
            for doc_id, text in zip(b.doc_id, b.text):
                s = ngram_set(text, n)
                key = set_key(s) if len(s) else None
                sid = _short(key) if key else None
                if key and once(sid):
                    np.add.at(counts, (s % np.uint64(size)).astype(np.int64), 1)
                out.append((doc_id, len(s), key, sid, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "key", "sid", "slice", "counts"], dtype=object).astype({"sid": "Int64", "slice": "Int32"})
        if counts.any():
            parts = counts.reshape(_SLICES, -1)
            yield pd.DataFrame({"doc_id": None, "n_shingles": 0, "key": None, "sid": None, "slice": range(_SLICES), "counts": [p.tobytes() for p in parts]}).astype({"sid": "Int64", "slice": "Int32"})

    # ids travel as strings: pandas would make floats of numbers with nulls
    rows = keep(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n_shingles long, key binary, sid long, slice int, counts binary"), "jaccard-sets")

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [b["slice"].iloc[0]], "counts": [sum(np.frombuffer(c, np.int32).astype(np.int64) for c in b.counts).tobytes()]})

    total = np.zeros((_SLICES, size // _SLICES), np.int64)
    for r in rows.where("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        total[r.slice] = np.frombuffer(r.counts, np.int64)
    return rows.where("slice is null").drop("slice", "counts").withColumn("doc_id", F.col("doc_id").cast("long")), total.reshape(-1)


def id_bits(ids: DataFrame, size: int) -> np.ndarray:
    """A table of size bits with those of the documents in ids (first)."""
    bit = F.pmod(F.xxhash64("first"), F.lit(size))
    words = ids.where("first is not null").select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
    found = words.toArrow()  # at most size / 64 rows of 16 bytes, in one job
    table = np.zeros(size // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table


class Wanted:
    """The texts of the documents in ids (sid, first), of null ids too, and few others.

    Up to MOST_FILTER bits a table of FILTER_BITS for each document is broadcast, so texts are not shuffled; beyond it the
    documents are joined by their ids. Both let through all that is wanted, so the result is the same.
    """

    def __init__(self, docs: DataFrame, ids: DataFrame, most_bits: int | None = None) -> None:
        size = 1 << max(6, (FILTER_BITS * ids.count() - 1).bit_length())
        self.bits = None
        if size <= (MOST_FILTER if most_bits is None else most_bits):
            self.bits = docs.sparkSession.sparkContext.broadcast(id_bits(ids, size))
            self.docs = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("bit"), F.col("doc_id").isNull().alias("free"))
        else:
            named = docs.where("doc_id is not null").join(ids.where("first is not null").select(F.col("first").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
            self.docs = named.select("text").unionByName(docs.where("doc_id is null").select("text"))

    def map(self, run: Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        bits = self.bits

        def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            flags = None if bits is None else bits.value
            for b in batches:
                if flags is None:
                    yield b.text
                else:
                    bit = b.bit.to_numpy()
                    yield b.text[((flags[bit >> 6] >> (bit & 63)) & 1 == 1) | b.free.to_numpy()]

        return self.docs.mapInPandas(lambda batches: run(texts(batches)), schema)


def prefixes(wanted: Wanted, n: int, percent: int, counts: Broadcast) -> DataFrame:
    """(token, sid, at) of the prefix columns of each set; at holds the set's size and the column's place."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        once, often = _Once(), counts.value
        for texts in batches:
            found: list[np.ndarray] = []
            meta: list[tuple[int, int, int]] = []
            for text in texts:
                s = ngram_set(text, n)
                if not len(s) or not once(sid := _short(set_key(s))):
                    continue
                c = often[(s % np.uint64(len(often))).astype(np.int64)]
                k = prefix_size(len(s), percent)
                near = np.flatnonzero(c <= np.partition(c, k - 1)[k - 1]) if k < len(s) else np.arange(len(s))
                found.append(s[near[np.lexsort((s[near], c[near]))][:k]])
                meta.append((sid, len(s), k))
            if found:
                k = [m[2] for m in meta]
                at = np.concatenate([(size << 32) + np.arange(x, dtype=np.int64) for _, size, x in meta])
                yield pd.DataFrame({"token": np.concatenate(found).view(np.int64), "sid": np.repeat(np.array([m[0] for m in meta], np.int64), k), "at": at})

    return wanted.map(run, "token long, sid long, at long")


def _may_link(percent: int):
    """Size-derived bounds on a pair of entries (n, place) and (m, spot) of one column."""
    n, m = F.col("n").cast("long"), F.col("m").cast("long")
    need = F.ceil(percent * (n + m) / F.lit(100 + percent))
    return (100 * n >= percent * m) & (100 * m >= percent * n) & (1 + F.least(n - 1 - F.col("place"), m - 1 - F.col("spot")) >= need)


def linked(pairs: DataFrame, docs: DataFrame, first: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, n, m) whose sets are similar enough.

    Overlaps are summed over blocks of columns. After the first block a pair goes on only if the columns that one set has
    there and the other lacks leave enough for the size-derived bound.
    """
    sids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = Wanted(docs, keep(first.join(sids.hint("merge"), "sid", "left_semi"), "jaccard-wanted"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        once = _Once()
        edges = np.array([k * ((1 << 64) // BLOCKS) for k in range(1, BLOCKS)], np.uint64)
        for texts in batches:
            out = []
            for text in texts:
                s = ngram_set(text, n)
                if len(s) and once(sid := _short(set_key(s))):
                    out += [(sid, k, part.tobytes()) for k, part in enumerate(np.split(s, np.searchsorted(s, edges))) if len(part)]
            yield pd.DataFrame(out, columns=["sid", "block", "grams"])

    # what is let through besides the wanted sets is dropped by the joins
    sets = keep(wanted.map(run, "sid long, block int, grams binary").dropDuplicates(["sid", "block"]), "jaccard-grams")
    side = lambda name, grams: sets.select(F.col("sid").alias(name), "block", F.col("grams").alias(grams))

    @F.pandas_udf("long")
    def shared(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or y is None else len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(left, right)], dtype="int64")

    head = pairs.join(side("b", "right").where("block = 0").drop("block").hint("merge"), "b", "left").join(side("a", "left").where("block = 0").drop("block").hint("merge"), "a", "left")
    size = lambda c: F.coalesce(F.octet_length(c) / 8, F.lit(0))
    need = F.ceil(percent * (F.col("n") + F.col("m")) / F.lit(100 + percent))
    head = head.select("a", "b", "n", "m", shared("left", "right").alias("both"), size("left").alias("in_a"), size("right").alias("in_b"))
    head = keep(head.where((F.col("in_a") - F.col("both") <= F.col("m") - need) & (F.col("in_b") - F.col("both") <= F.col("n") - need)).select("a", "b", "n", "m", "both"), "jaccard-head")
    tail = head.select("a", "b").join(side("b", "right").where("block > 0").hint("merge"), "b").join(side("a", "left").where("block > 0").hint("merge"), ["a", "block"])
    more = tail.select("a", "b", shared("left", "right").alias("more")).groupBy("a", "b").agg(F.sum("more").alias("more"))
    both = F.col("both") + F.coalesce("more", F.lit(0))
    out = keep(head.join(more.hint("merge"), ["a", "b"], "left").where(100 * both >= percent * (F.col("n") + F.col("m") - both)).select("a", "b"), "jaccard-links")
    forget(sets)
    return out


def link_sets(docs: DataFrame, first: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(a, b) of sids: links enough to connect all rows that links connect. first: (sid, first), a document of each set."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    # one document of each set is enough, so copies are read and left out before anything is shuffled
    entries = prefixes(Wanted(docs, first), n, percent, shared).repartition(F.col("token"))
    place = F.col("at").bitwiseAND((1 << 32) - 1)
    # the pivot of a column is the row in which the column stands first; equal ends mean that there is one row.
    # both sides of the join read one shuffle of the entries
    lead = F.shiftleft(place, 33).bitwiseOR(F.col("sid").bitwiseAND((1 << 33) - 1))
    tops = entries.groupBy("token").agg(F.min(lead).alias("top"), F.max(lead).alias("end")).where("top != end").select("token", "top")
    columns = keep(entries.join(tops.hint("merge"), "token").dropDuplicates(["token", "sid"]).select("token", "sid", F.shiftright("at", 32).alias("n"), place.alias("place"), (lead == F.col("top")).alias("pivot")), "jaccard-columns")
    pivot = columns.where("pivot").select("token", F.col("sid").alias("a"), F.col("n").alias("m"), F.col("place").alias("spot"))
    pairs = keep(columns.join(pivot.hint("merge"), "token").where("sid != a").where(_may_link(percent)).select("a", F.col("sid").alias("b"), "n", "m").dropDuplicates(["a", "b"]), "jaccard-pairs")
    links = linked(pairs, docs, first, n, percent)
    member = keep(components(links), "jaccard-members").select(F.col("node").alias("sid"), "component")
    placed = keep(columns.select("token", "sid", "n", "place").join(member.hint("merge"), "sid", "left").withColumn("component", F.coalesce("component", "sid")), "jaccard-placed")
    open_ = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token")
    left = keep(placed.join(open_.hint("merge"), "token", "left_semi"), "jaccard-open")
    right = left.select("token", F.col("sid").alias("a"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("component").alias("other"))
    # in a sorted column only rows of a larger id and another component are paired
    rest = left.join(right.hint("merge"), (left["token"] == right["token"]) & (F.col("a") < F.col("sid")) & (F.col("other") != F.col("component")) & _may_link(percent))
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = keep(rest.select("a", F.col("sid").alias("b"), "n", "m").dropDuplicates(["a", "b"]).join(tested.hint("merge"), ["a", "b"], "left_anti"), "jaccard-rest")
    if not more.isEmpty():
        links = links.unionByName(linked(more, docs, first, n, percent))
    for done in (columns, pairs, placed, left, more):  # the links are written
        forget(done)
    return links


def cluster(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, sid, component, component_id of every row; sid and component name sets and are null without words."""
    small_batches(docs.sparkSession)
    rows, counts = read_sets(docs, n)
    # a clash of two sets in the first 64 bits of their keys would join strangers: it is looked for and never passed over
    clash = rows.where("sid is not null").groupBy("sid").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low != high")
    if not clash.isEmpty():
        raise ValueError("two different n-gram sets have the same 64-bit key")
    least = keep(rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first")), "jaccard-first")
    member = components(link_sets(docs, least, n, percent, counts))
    placed = least.join(member.withColumnRenamed("node", "sid").hint("merge"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    placed = keep(placed, "jaccard-least")
    names = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    names = placed.select("sid", "component").join(names.hint("merge"), "component").select("sid", "component", "component_id")
    out = rows.join(names.hint("merge"), "sid", "left")
    return out.select("doc_id", "n_shingles", "sid", "component", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def join_documents(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return cluster(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Of each group that links connect one row stays: the one with the least doc_id. Rows without words stay, each of them.

    Unlike texts under one id are told apart by their sets, so no group goes whole: of a group whose least doc_id stands at
    several texts the one with the least set key stays (of equal sets the least text hash). A group of null ids only keeps one of its rows.
    """
    names = docs.columns
    found = keep(cluster(docs, n, percent), "jaccard-clusters")
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = docs.where(~empty & F.col("doc_id").isNotNull())
    kept = found.where("sid is not null and component_id = doc_id").groupBy("component", "doc_id").agg(F.min("sid").alias("_sid_kept")).select("doc_id", "_sid_kept")
    many = found.where("sid is not null and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    many, kept = keep(many, "jaccard-many"), keep(kept, "jaccard-kept")
    # an id of one row needs no look at its text
    once = named.join(kept.select("doc_id").join(many.hint("merge"), "doc_id", "left_anti").hint("merge"), "doc_id", "left_semi").select(*names)

    @F.pandas_udf("long")
    def sid(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _short(set_key(ngram_set(t, n)))).astype("int64")

    def one_of(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
        """One row for each wanted key; names of its own are told apart from the columns of docs by nesting these."""
        rows = rows.select(*[F.col(k) for k in keys if k == "doc_id"], F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), sid("text").alias("_sid_kept"))
        return rows.join(wanted.hint("merge"), keys, "left_semi").groupBy(*keys).agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row.*")

    again = one_of(named.join(many.hint("merge"), "doc_id", "left_semi"), kept, ["doc_id", "_sid_kept"])
    free = found.where("sid is not null and component_id is null").groupBy("component").agg(F.min("sid").alias("_sid_kept")).select("_sid_kept")
    nameless = one_of(docs.where(~empty & F.col("doc_id").isNull()), free, ["_sid_kept"])
    return once.unionByName(again).unionByName(nameless).unionByName(docs.where(empty))
