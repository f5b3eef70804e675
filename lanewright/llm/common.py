"""Shared pieces of the training-data operators: staging, word splitting, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections import namedtuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a local one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lanewright-"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get()


def _path(spark: SparkSession, path: str):
    """The path and its file system, on the JVM side."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    The table is deleted when the driver ends; ``discard`` deletes it sooner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``staged`` that no later plan reads."""
    at, files = _path(df.sparkSession, df.staged_at)
    files.delete(at, True)


#: A class of more than one in this many rows is hot, so there are fewer hot classes than this.
HOT_SHARE = 1000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, copies: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined to the columns of ``classes``, which has one row for each ``key``; ``copies`` says how many ``rows`` have it.

    Of ``total`` rows fewer than HOT_SHARE classes have over total / HOT_SHARE
    each; those are broadcast, so no class, however large, meets in one task.
    """
    hot, cold = (classes.filter(pick).withColumnRenamed(key, "__key") for pick in (F.col(copies) > total / HOT_SHARE, F.col(copies) <= total / HOT_SHARE))
    first = rows.join(F.broadcast(hot), F.col(key) == F.col("__key")).drop("__key")
    rest = rows.join(F.broadcast(hot.select("__key")), F.col(key) == F.col("__key"), "left_anti")
    return first.unionByName(rest.join(cold, F.col(key) == F.col("__key"), how).drop("__key"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) on a uint64 array."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Bytes whose hashes are summed at a time, and the longest word that is hashed that way.
SEGMENT, LONG_WORD = 1 << 17, 4096
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9FB21C651E98DF25
_POWERS = np.cumprod(np.array([1, *[_BASE] * (SEGMENT + LONG_WORD)], np.uint64))
_INVERSES = np.cumprod(np.array([1, *[pow(_BASE, -1, 1 << 64)] * SEGMENT], np.uint64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

#: Words of several texts: the joined bytes, first byte and byte after the last of each word, number of words of each text.
Spans = namedtuple("Spans", "buf starts ends counts")


def word_spans(texts: list[bytes], lower: bool = False) -> Spans:
    """The words of ``texts``, cut at ASCII white space; with ``lower`` A-Z are read as a-z."""
    joined = b"\n" + b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)  # lower() of bytes knows ASCII only
    space = _SPACE[buf]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = turns[0::2], turns[1::2]
    after = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return Spans(buf, starts, ends, np.diff(np.searchsorted(starts, after), prepend=0))


def span_hashes(spans: Spans) -> np.ndarray:
    """A 64-bit hash of every word: its bytes' sum over powers of an odd base, found from running sums."""
    out = np.zeros(len(spans.starts), np.uint64)
    cuts = np.searchsorted(spans.starts, np.arange(0, len(spans.buf) + SEGMENT, SEGMENT))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        if lo < hi:
            at = k * SEGMENT
            piece = spans.buf[at : at + SEGMENT + LONG_WORD]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTES[piece] * _POWERS[: len(piece)], out=sums[1:])
            first, last = spans.starts[lo:hi] - at, np.minimum(spans.ends[lo:hi] - at, len(piece))
            out[lo:hi] = (sums[last] - sums[first]) * _INVERSES[first]
    sizes = spans.ends - spans.starts
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(spans.buf[spans.starts[i] : spans.ends[i]].tobytes())
    return mix(out + sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def rolling(h: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive values; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    b = np.uint64(base | 1)
    for i in range(n):
        out = out * b + h[i : i + m]
    return mix(out)


def text_chunks(batches, columns: list[str], text: str = "t", limit: int = 2_000_000):
    """Lists of the given columns and of text bytes, cut so that a chunk has about ``limit`` bytes (one text at least).

    Null texts come as empty bytes.
    """
    for batch in batches:
        column = batch.column(text).cast("binary").to_pylist()
        rest = [batch.column(c).to_pylist() for c in columns]
        start, held = 0, 0
        for i, value in enumerate(column):
            held += len(value or b"")
            if held >= limit or i == len(column) - 1:
                yield [r[start : i + 1] for r in rest], [v or b"" for v in column[start : i + 1]]
                start, held = i + 1, 0
