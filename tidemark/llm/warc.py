"""WARC records and a Merkle fixity audit of replicas.

A record's digest is the SHA-256 of its bytes. In each file the records stand
by offset; a leaf hashes a record's digest with its offset and length, runs of
``FANOUT`` consecutive leaves are hashed into a node, runs of nodes into the
next level, up to one root per file (leaves and nodes with prefixes of their
own). Two replicas of a file agree if their roots do; where they differ, only
the children of differing nodes are compared, level by level, down to the
records and their byte ranges.

A replica's records take the places that the primary's manifest gives them; a
record that one side lacks counts there as the digest ``missing``, and so does a
whole file. Records that only the replica holds have no offset, length and id.
Null urls and bodies are written as empty; repeated rows are records of their
own, told apart by their place; ids that repeat stand in one file. Null ids are
dealt over NULL_FILES files by their digest, so none of them is one task. Very
long bodies are hashed whole. Other columns stay out of the manifest. An empty
manifest has no trees and no findings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, keep

FANOUT = 16
PER_FILE = 1000
NULL_FILES = 1024


def record_text(page_id: Column, url: Column, body: Column) -> Column:
    """A response record: header lines, an empty line, the body, two line ends."""
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame, per_file: int = PER_FILE, copy: Column | None = None) -> DataFrame:
    """file, place, offset, length, page_id, digest: a file holds the pages of ``per_file`` consecutive ids; null ids are dealt over the files -1 to -NULL_FILES.

    copy: the digest of a row's record in a replica, null where it lacks the record; carried along as copy_digest.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    record = record_text(F.col("page_id"), F.col("url"), body)
    digest = F.sha2(F.encode(record, "utf-8"), 256)
    nameless = -1 - F.pmod(F.xxhash64(digest), F.lit(NULL_FILES))
    rows = pages.select("page_id", F.coalesce(F.floor(F.col("page_id") / per_file), nameless).cast("long").alias("file"), F.octet_length(record).cast("long").alias("length"), digest.alias("digest"), *([] if copy is None else [copy.alias("copy_digest")]))
    order = Window.partitionBy("file").orderBy("page_id", "digest", *rows.columns[4:])
    return rows.select("file", (F.row_number().over(order) - 1).cast("long").alias("place"), (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "page_id", "digest", *rows.columns[4:])


def leaf(offset: Column, length: Column, digest: Column) -> Column:
    """Hash of a record and its byte range; a prefix keeps leaves and nodes apart."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.encode(F.concat_ws("|", F.lit("leaf"), number(offset), number(length), digest), "utf-8"), 256)


def levels(leaves: DataFrame, top: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables (file, place, digest) of each level, the leaves first; ``top`` is the largest place of a leaf.

    A node hashes the ordered hashes and places of what is under it.
    """
    out = [leaves.select("file", "place", "digest")]
    while top > 0:
        below = out[-1].select("file", F.floor(F.col("place") / fanout).alias("up"), "place", "digest")
        under = F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["digest"]))
        node = F.sha2(F.encode(F.concat(F.lit("node|"), F.array_join(under, "|")), "utf-8"), 256)
        out.append(keep(below.groupBy("file", "up").agg(node.alias("digest")).select("file", F.col("up").alias("place"), "digest"), "merkle"))
        top //= fanout
    return out


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records that differ: file, place, offset, length, page_id, digest, replica_digest, replica_offset, replica_length.

    primary: a manifest; replica: (file, place, digest), without the records it lacks. If the replica has offset and length
    too, a record that was moved or resized differs even where its bytes are the same; else it has the primary's ranges.
    """
    primary = keep(primary, "manifest")
    ranges = "offset" in replica.columns and "length" in replica.columns
    where = [F.col(c).cast("long") if ranges else F.lit(None).cast("long") for c in ("offset", "length")]
    held = replica.select(F.col("file").alias("f"), F.col("place").alias("p"), F.col("digest").alias("d"), where[0].alias("o"), where[1].alias("n"))
    # both trees have the places that either side holds
    both = primary.join(held.hint("merge"), (F.col("file") == F.col("f")) & (F.col("place") == F.col("p")), "full")
    own = (F.col("o"), F.col("n")) if ranges else (F.col("offset"), F.col("length"))
    lost = F.lit("missing")
    both = keep(
        both.select(
            F.coalesce("file", "f").alias("file"), F.coalesce("place", "p").alias("place"), F.coalesce("digest", lost).alias("digest"), F.coalesce("d", lost).alias("replica_digest"), F.col("o").alias("replica_offset"), F.col("n").alias("replica_length"),
            F.when(F.col("digest").isNull(), lost).otherwise(leaf(F.col("offset"), F.col("length"), F.col("digest"))).alias("ours"), F.when(F.col("d").isNull(), lost).otherwise(leaf(*own, F.col("d"))).alias("theirs"),
        ),
        "replica",
    )
    top = both.agg(F.max("place")).first()[0] or 0
    ours, theirs = levels(both.select("file", "place", F.col("ours").alias("digest")), top, fanout), levels(both.select("file", "place", F.col("theirs").alias("digest")), top, fanout)
    differing = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        b = b.select("file", "place", F.col("digest").alias("other"))
        if differing is not None:
            up = differing.select("file", F.col("place").alias("up")).hint("merge")
            a = a.withColumn("up", F.floor(F.col("place") / fanout)).join(up, ["file", "up"], "left_semi")
            b = b.withColumn("up", F.floor(F.col("place") / fanout)).join(up, ["file", "up"], "left_semi").drop("up")
        before = differing
        differing = keep(a.select("file", "place", "digest").join(b.hint("merge"), ["file", "place"]).where("digest != other").select("file", "place"), "differing")
        if before is not None:
            forget(before)
    for level in [*ours[1:], *theirs[1:]]:  # the first are views of what both sides hold
        forget(level)
    found = differing.join(both.drop("ours", "theirs").hint("merge"), ["file", "place"]).join(primary.drop("digest").hint("merge"), ["file", "place"], "left")
    return found.select("file", "place", "offset", "length", "page_id", "digest", "replica_digest", "replica_offset", "replica_length")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, place, offset, length, record_id, uri, digest of every record of the WARC files (plain or gzip) at a path.

    A file is one row, so files should keep to the customary size of about 1 GB; the rest of a file after a broken header is one last record without id.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        import hashlib

        for b in batches:
            for path, data in zip(b.path, b.content):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)
                rows, at = [], 0
                while at < len(data):
                    head = data.find(b"\r\n\r\n", at)
                    fields = dict(x.split(b": ", 1) for x in data[at:head].split(b"\r\n")[1:] if b": " in x) if head >= 0 else {}
                    size = fields.get(b"Content-Length", b"")
                    end = min(len(data), head + 4 + int(size) + 4) if size.isdigit() else len(data)
                    text = [fields.get(k, b"").decode("utf-8", "replace") for k in (b"WARC-Record-ID", b"WARC-Target-URI")]
                    rows.append((path, len(rows), at, end - at, *text, hashlib.sha256(data[at:end]).hexdigest()))
                    at = end
                yield pd.DataFrame(rows, columns=["file", "place", "offset", "length", "record_id", "uri", "digest"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, place long, offset long, length long, record_id string, uri string, digest string")
