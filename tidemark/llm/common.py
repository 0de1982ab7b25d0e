"""What the operators of this subpackage share: words, tables kept between stages, text columns."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII blanks. The same rule for Python, Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
_BLANKS = str.maketrans("\t\n\x0b\x0c\r", "     ")


def words_of(text: str | None) -> list[str]:
    """Words of a whole text; none for null."""
    return [w for w in text.translate(_BLANKS).split(" ") if w] if text else []


def utf8_words(text: str | None) -> list[bytes]:
    """The same words as UTF-8; bytes.split() parts at just the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def words_col(text: Column) -> Column:
    """Words of a text column as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset a session on one machine gets a temporary one; a cluster cannot."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN_DIRS[app] = _OWN_DIRS.get(app) or tempfile.mkdtemp(prefix="spark-shared-")
    return path.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than Spark's default, which suits texts; stays set for the session, as plans are lazy. A number that the user has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, gives true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)  # what forget() does not delete goes with the session
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what keep() wrote, once nothing reads it any more."""
    path = getattr(df, "_kept_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


_BASE = 0xA24BAED4963EE407  # odd, so it has an inverse modulo 2**64
_PIECE = 1 << 20


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) <= n:
            size = len(self.up)
            up, down = (np.uint64(pow(x, size, 1 << 64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
            self.up, self.down = np.concatenate((self.up, self.up * up)), np.concatenate((self.down, self.down * down))
        return self.up, self.down


_POWERS = _Powers()


def hash_words(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, in order: a polynomial of its bytes, taken from prefix sums, then mixed with its length.

    Long texts go in pieces that end at blanks, so memory follows the piece and the longest word.
    """
    out, at = [], 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:
                nexts = [k for k in (data.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if k >= 0]
                cut = min(nexts, default=len(data) - 1)
            end = cut + 1
        piece = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        at = end
        blank = np.ones(len(piece) + 2, bool)
        blank[1:-1] = (piece == 32) | ((piece >= 9) & (piece <= 13))
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        if not len(edges):
            continue
        first, last = edges[0::2], edges[1::2]
        up, down = _POWERS.upto(len(piece))
        sums = np.empty(len(piece) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        out.append(mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX2
    x = (x ^ (x >> np.uint64(29))) * _MIX1
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words from the words' hashes (a polynomial modulo 2**64, then mixed)."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _MIX1 + h[k : k + len(out)]
    return mixed(out)
