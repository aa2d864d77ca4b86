"""Helpers that several corpus operators share.

Two families live here: small Spark helpers (checkpoint folder, native "let" binding for higher-order
functions) and numpy kernels that work on the UTF-8 buffer of an Arrow string column without making a
Python object per word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words: blank and \t \n \v \f \r.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Bytes of a row group in tables that cut a lineage; a task holds one in memory.
ROW_GROUP = 16 << 20
#: Rows that a Python worker has in its temporaries at once, and bytes of their texts.
ROWS, BYTES = 512, 1 << 18


# ---------------------------------------------------------------- Spark helpers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; choose one only where that setting is absent.

    A local master may use a temporary folder. On a cluster without the setting the warehouse folder is
    taken, which all machines share.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if not named:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        named = tempfile.mkdtemp(prefix="corvane-checkpoint-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoint"
    sc.setCheckpointDir(named)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared checkpoint folder and go on from there; lost executors cost no recomputation.

    A table rather than checkpoint(), whose plan keeps the estimated size of what it was made from: over rounds of joins that estimate
    grows into numbers of millions of digits. A table's size is known.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows. createDataFrame() would start Python workers for it, which stay in the executors' memory for a while."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a bound variable.

    Catalyst may inline a projected column into the lambda that uses it, where it would be computed once per
    element. A lambda variable is never inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


# ---------------------------------------------------------------- Arrow and numpy kernels

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it

Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Give memory that is free back to the system. A worker outlives its task, and what it keeps counts as the executor's."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Batches]) -> Callable[[Iterable[pa.RecordBatch]], Batches]:
    """`run` for mapInArrow, fed with ROWS rows at once whatever a batch holds; after each batch and at the end, free memory is given back."""

    def fed(batches: Iterable[pa.RecordBatch]) -> Batches:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                yield whole.slice(i, ROWS)
            release()

    def fed_run(batches: Iterable[pa.RecordBatch]) -> Batches:
        yield from run(fed(batches))
        release()

    return fed_run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, and where each starts (one more entry than strings). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    starts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row: temporaries stay small whatever a batch holds."""
    n, i = len(starts) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(BYTES, 1 << n.bit_length())
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0], _powers[1]


def word_spans(data: np.ndarray, starts: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are no gap bytes; a run never crosses rows."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    empty = gap[data]
    full = ~empty
    first, last = full.copy(), full.copy()
    first[1:] &= empty[:-1]
    last[:-1] &= empty[1:]
    at = starts[:-1][starts[:-1] < n]
    first[at] = full[at]
    at = starts[1:][starts[1:] > 0] - 1
    last[at] = full[at]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(starts, s, side="right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, by polynomial prefix sums over the whole buffer."""
    if not len(s):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s])


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


def ngram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n words of one row in sequence, and the index of each one's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = constants(n, 17 * n)
    m = len(words) - n + 1
    h = words[:m] * c[0]
    for k in range(1, n):
        h = h + words[k : k + m] * c[k]
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(h[at] + np.uint64(n)), at


BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
