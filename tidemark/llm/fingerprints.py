"""Document fingerprints by winnowing (DataFrame functions only).

A text's k-grams are runs of ``K`` = 5 words; each has a 64-bit hash, of which
36 bits are compared. In every window of ``W`` = 8 consecutive k-grams the
least hash is selected, the rightmost on ties, and kept with its position. So
any run of W + K - 1 = 12 words that two texts share gives both a common
fingerprint (the match guarantee), and shared runs under K words none.

A text with fewer than K words has one gram, all its words; without words, or
null, it has none and its fingerprint is empty. Likeness is the Jaccard
similarity of the sets of hashes, 1 for two empty sets.

The order of documents is by descending doc_id, equal ids by text hash, null
ids last; rows are dealt by ranges of doc_id (rows of a frequent id, or of null
ids, by their text hash besides), each range also gets a copy of the first row
of the next one, so the next document is found inside a range. Very long texts
are taken whole, up to 2**28 words. Other columns stay out of the result; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, words_col

K, W = 5, 8
_POS = 28
_POS_MASK = (1 << _POS) - 1


def gram_values(words: str) -> Column:
    """(hash, reversed position) of each k-gram packed in a long: the least value is the least hash, the rightmost of equals."""
    n = F.size(words)
    pack = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, _POS), _POS).bitwiseOR(F.lit(_POS_MASK).cast("long") - i)
    grams = F.transform(F.slice(words, 1, n - (K - 1)), lambda x, i: pack(F.xxhash64(x, *[F.get(words, i + j) for j in range(1, K)]), i))
    return F.when(n >= K, grams).when(n > 0, F.array(pack(F.xxhash64(F.array_join(words, " ")), F.lit(0)))).otherwise(F.array().cast("array<long>"))


def select(values: str) -> Column:
    """The selected values, each once, in the order of their positions."""
    n = F.size(values)
    least = F.transform(F.slice(values, 1, n - (W - 1)), lambda x, i: F.least(x, *[F.get(values, i + j) for j in range(1, W)]))
    return F.array_distinct(F.when(n >= W, least).when(n > 0, F.array(F.array_min(values))).otherwise(F.array().cast("array<long>")))


def hashes(selected: str | Column) -> Column:
    return F.transform(selected, lambda v: F.shiftrightunsigned(v, _POS))


def positions(selected: str | Column) -> Column:
    return F.transform(selected, lambda v: (F.lit(_POS_MASK).cast("long") - v.bitwiseAND(_POS_MASK)).cast("int"))


def as_string(selected: str) -> Column:
    """hash@position of each selected gram, space-separated."""
    return F.array_join(F.transform(selected, lambda v: F.concat(F.lower(F.hex(F.shiftrightunsigned(v, _POS))), F.lit("@"), (F.lit(_POS_MASK).cast("long") - v.bitwiseAND(_POS_MASK)).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the selected values of column text in column out."""
    kept = df.columns
    a = df.select(*kept, words_col(F.col(text)).alias("_words"))
    b = a.select(*kept, gram_values("_words").alias("_values"))
    return b.select(*kept, select("_values").alias(out))


def _range_of(doc_id: Column, tops: list[int]) -> Column:
    """How many of the descending tops are not below an id: a binary search in one constant array."""
    table = F.split(F.lit(",".join(map(str, tops))), ",").cast("array<long>")
    steps = [1 << k for k in reversed(range(len(tops).bit_length()))]
    onward = lambda at, step: F.coalesce(F.get(table, at + step - 1) >= doc_id, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(onward(at, step), step).otherwise(0))


def deal(slim: DataFrame, ranges: int) -> DataFrame:
    """slim with part: numbers of ranges in the order of documents, of about equally many rows each.

    A quantile of the ids that comes k times is an id with k ranges' rows; its rows are dealt into k parts by their tie, as
    are those of null ids, so no id is one part.
    """
    rows, nulls = slim.agg(F.count("*"), F.count("*") - F.count("doc_id")).first()
    found = slim.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0]
    times = Counter(map(int, found or []))
    tops = sorted(times, reverse=True)
    starts = [0]  # first part of the range above all tops, then of each range; a range of a frequent id has parts for it alone
    for t in tops:
        starts.append(starts[-1] + (1 if len(starts) == 1 else width))
        width = times[t] + 1 if times[t] > 1 else 1
    last = starts[-1] + (width if tops else 1)
    slots = -(-ranges * nulls // rows) if nulls else 1
    slot = lambda k: F.least(k - 1, F.floor((F.col("tie") / 2.0**64 + 0.5) * k)).cast("int")
    if not tops:
        return slim.withColumn("part", slot(F.lit(slots)))
    constant = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<long>")
    dealt = slim.withColumn("r", _range_of(F.col("doc_id"), tops))
    own, k = F.get(constant([0, *tops]), F.col("r")) == F.col("doc_id"), F.get(constant([1, *(times[t] for t in tops)]), F.col("r")).cast("int")
    inside = F.when(F.col("r") == 0, 0).when(k == 1, 0).when(own, slot(k)).otherwise(k)
    part = F.when(F.col("doc_id").isNull(), F.lit(last) + slot(F.lit(slots))).otherwise(F.get(constant(starts), F.col("r")) + inside)
    return dealt.select(*slim.columns, part.cast("int").alias("part"))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows with their next_text (null: empty) and copies of range heads, by descending doc_id; the last row is followed by the first."""
    ranges = ranges or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = deal(slim, ranges)
    # the first row of each part: the largest id, nulls last, then the least tie; each goes into the part before, the first into the last
    head = F.max(F.struct("doc_id", F.bitwise_not("tie").alias("not_tie"))).alias("head")
    heads = dealt.groupBy("part").agg(head)
    line = Window.orderBy("part")  # one row for each part
    heads = heads.select("part", "head.doc_id", F.bitwise_not("head.not_tie").alias("tie"), F.coalesce(F.lag("part").over(line), F.max("part").over(Window.partitionBy())).alias("into"))
    heads = keep(heads, "range-heads").select(F.col("part").alias("p"), F.col("doc_id").alias("i"), F.col("tie").alias("t"), "into")
    # at most about twice as many heads as ranges, of 28 bytes each
    first = dealt.join(F.broadcast(heads), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))
    copies = first.groupBy("into", "doc_id", "tie").agg(F.min("text").alias("text")).select("doc_id", "text", "tie", F.col("into").alias("part"), F.lit(True).alias("copy"))
    order = Window.partitionBy("part").orderBy("copy", F.desc_nulls_last("doc_id"), "tie")
    both = dealt.withColumn("copy", F.lit(False)).unionByName(copies)
    return both.select("doc_id", "text", "copy", "part", "tie", F.lead("text").over(order).alias("next_text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The contract's query: fingerprints of every text and of its edited text, and their likenesses."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    a = with_next(docs)
    edited = F.concat(F.substring("text", 1, n - third), F.substring(F.coalesce("next_text", F.lit("")), 1, third))
    a = a.select("doc_id", "text", "copy", "part", "tie", n.cast("long").alias("n_chars"), edited.alias("edited"))
    a = add_fingerprint(a, "text", "own")
    a = add_fingerprint(a, "edited", "changed")
    line = Window.partitionBy("part").orderBy("copy", F.desc_nulls_last("doc_id"), "tie")
    b = a.select("doc_id", "copy", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "own", "changed", F.lead("own").over(line).alias("following")).where("not copy")
    c = b.select("doc_id", "n_chars", "edited_sha256", "own", "changed", F.array_distinct(hashes("own")).alias("h"), F.array_distinct(hashes("changed")).alias("e"), F.array_distinct(hashes(F.coalesce("following", F.array().cast("array<long>")))).alias("f"))
    return c.select("doc_id", "n_chars", "edited_sha256", as_string("own").alias("fingerprint"), as_string("changed").alias("edited_fingerprint"), likeness("h", "e").alias("near_edited"), likeness("h", "f").alias("near_next"))
