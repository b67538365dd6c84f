"""Shared pieces of the training-data operators.

Everything that reads texts on the executors works on the UTF-8 bytes of an Arrow batch with numpy, a bounded slice at a
time, so the memory of a Python worker follows ``CHUNK_BYTES`` (or the longest single text), never the batch or partition.
"""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.session import ship

#: Bytes of text that numpy works on at a time.
CHUNK_BYTES = 1 << 19
#: Java's and Python's spelling of what separates words.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ------------------------------------------------------------------ session and storage


def prepare(spark: SparkSession) -> None:
    """Let the executors' Python import this package, and bound what one Arrow batch holds, whatever the texts' length."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of the session, or of its context.

    Where neither names one, a temporary one, but only on a local master: elsewhere each machine would write to its own disk
    and read back what it wrote itself, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + _local_dir()
    return found.rstrip("/")


@functools.lru_cache(1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="sijill-")


_written: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    An executor that is lost takes nothing with it: the files are in the shared store, and an unfinished write is
    repeated by task. The files go when ``release`` is called with the table, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete what ``stored`` wrote for these tables; nothing that is still to be run may read them."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path in _written:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone when Python ends; nothing is lost by that
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str | Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts


# ------------------------------------------------------------------ texts as bytes


class Texts:
    """Rows ``first`` to ``first + n`` of a batch: the bytes of their texts, end to end, and where each begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.n = first, data, offsets, len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each word in ``data``, and for each text (and the end) the number of its first word."""
        data, n = self.data, len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        space = _SPACE[data]
        before = np.empty(n + 1, bool)
        before[1:] = space
        before[0] = True
        before[self.offsets] = True
        begin = np.flatnonzero(before[:-1] & ~space)
        after = np.empty(n + 1, bool)
        after[:-1] = space
        after[self.offsets] = True
        end = np.flatnonzero(after[1:] & ~space) + 1
        return begin, end, np.searchsorted(begin, self.offsets)


def texts(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Slices of about ``chunk_bytes`` of a string column; a null text has no bytes. A longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, where, what = column.buffers()
    at = np.frombuffer(where, wide, n + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None and at[-1] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + chunk_bytes, "right")) - 1)
        yield Texts(first, data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


# ------------------------------------------------------------------ hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers for ``seed``."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x1000003))


_BYTE = numbers(11, 256)
_BASE = int(numbers(12, 1)[0]) | 1
_BASE_BACK = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest text needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, CHUNK_BYTES + (1 << 16))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)])) for b in (_BASE, _BASE_BACK))
        return self.up, self.down


_powers = _Powers()


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z taken as a-z, from prefix sums over the whole slice.

    ``table`` gives another number to each byte value (0: the byte doesn't count but keeps its place).
    """
    if not len(begin):
        return np.zeros(0, np.uint64)
    up, down = _powers.upto(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_BYTE[_LOWER] if table is None else table)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words of one text; of all its words, if they are fewer; of nothing, if none."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    factors = numbers(13, width)
    total = words[: n - k + 1] * (factors[0] | np.uint64(1))
    for i in range(1, k):
        total = total + words[i : n - k + 1 + i] * (factors[i] | np.uint64(1))
    return mix(total + np.uint64(k))


def shingle_sets(batch: Texts, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, in ascending order."""
    begin, end, at = batch.words()
    hashes = word_hashes(batch.data, begin, end)
    for i in range(batch.n):
        yield np.unique(shingle_hashes(hashes[at[i] : at[i + 1]], width))
