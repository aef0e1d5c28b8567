"""Shared plumbing: scratch space that every executor sees, and vectorised text scanning.

Words are runs of bytes other than space and 0x09-0x0D, the same definition in
every operator. Scans work on slices of a few megabytes, so a worker's memory
follows the slice (or the longest single text), not the partition.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 2 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}
_made: list[tuple] = []


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: a text may be long, and batches are sized by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or else the context's checkpoint folder.

    Without either, a folder of our own serves where driver and executors are one process; on a cluster, whose
    machines would not see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and there.isDefined():
        base = there.get()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.get("dir")
        if not base:
            base = _local["dir"] = "file://" + tempfile.mkdtemp(prefix="lakemill-")
    if there.isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/") + "/lakemill"


def new_dir(spark: SparkSession, kind: str) -> str:
    path = f"{scratch(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written() -> int:
    """The number of intermediate tables there are."""
    return len(_made)


def forget(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Remove the session's intermediate tables after the first ``since``, but for the ``keep`` last ones."""
    own = [x for x in _made[since:] if x[0] is spark]
    for item in own[: len(own) - keep]:
        _made.remove(item)
        delete(*item)


def release() -> None:
    """Remove every intermediate table written so far; results that read them are then gone too."""
    while _made:
        spark, path = _made.pop()
        try:
            delete(spark, path)
        except Exception:  # the session may have ended; its folder belongs to the cluster
            continue


atexit.register(release)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame, kind: str = "table") -> DataFrame:
    """Cut lineage with a table in the shared folder; a lost executor costs nothing written.

    Shuffle files of the write go when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_dir(spark, kind)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give freed memory back to the system: workers are reused, and the next task may be another worker's."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


# ---------------------------------------------------------------- Arrow slices


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Yield (first row, end row, bytes, offsets) over consecutive rows; nulls are empty."""
    arr = batch.column(batch.schema.get_field_index(column))
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if n == 0:
        return
    _, off, buf = arr.buffers()
    offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


# ---------------------------------------------------------------- hashing

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_pow = {"n": 0, "p": np.zeros(0, np.uint64), "q": np.zeros(0, np.uint64)}
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        size = max(n, min(2 * n, SLICE_BYTES), 1 << 16)
        with np.errstate(over="ignore"):
            for key, base in (("p", _P), ("q", _PINV)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _pow[key] = np.multiply.accumulate(x)
        _pow["n"] = size
    out = _pow["p"][:n], _pow["q"][:n]
    if _pow["n"] > 4 * SLICE_BYTES and n <= SLICE_BYTES:  # one long text is no reason to keep long tables
        _pow.update(n=0)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer over 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P)) | np.uint64(1)


def spans_of_words(data: np.ndarray, offs: np.ndarray, space_of: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (n + 1 entries)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = space_of[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1] | edge[1:n]
    last = word
    last[:-1] &= space[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, independent of where it stands."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    p, q = powers(len(data))
    with np.errstate(over="ignore"):
        c = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * p, out=c[1:])
        return mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words of one text, and the index of each one's first word.

    A text of 1 to n - 1 words has one n-gram: all its words.
    """
    count = np.diff(first)
    total = len(words)
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(n, np.uint64)])
        h = np.zeros(total, np.uint64)
        left = np.repeat(first[1:], count) - np.arange(total)  # words from here to the text's end
        for k in range(n):
            part = padded[k : k + total]
            if k:
                part = np.where(left > k, part, np.uint64(0))
            h = h * np.uint64(_P) + part
        h = mix(h)
    keep = left >= n
    short = (count > 0) & (count < n)
    keep[first[:-1][short]] = True
    at = np.flatnonzero(keep)
    return h[at], at


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals of UTF-8 folded."""
    out = _LOWER[data]
    if len(out) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[at] += 0x20
    return out


def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes; start and end of each run of ASCII letters and bytes over 127; each text's first run."""
    low = lower(data)
    return (low, *spans_of_words(low, offs, NOT_LETTER))
