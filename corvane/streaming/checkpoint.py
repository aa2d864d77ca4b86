"""Resumable generation: every unit is recorded once, a restart goes on where the last run stopped.

The sink is a folder of Parquet batches named by their number; a batch that is written again replaces itself, so a restart
after a crash neither loses nor repeats records. One writer at a time holds the folder's lock.
"""

from __future__ import annotations

import os
import socket
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schemas import AUDIT
from ..sources.artifacts import _hadoop


class Locked(RuntimeError):
    """Another writer holds the folder."""


class Breaker(RuntimeError):
    """Too many provider failures in a row."""


class Repeated(ValueError):
    """A unit was recorded twice."""


class RunLock:
    """A file that only one writer can create. It is never taken over; a crashed run's lock is removed by hand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.path = spark, f"{folder.rstrip('/')}/_LOCK"

    def __enter__(self) -> RunLock:
        p, fs = _hadoop(self.spark, self.path)
        fs.mkdirs(p.getParent())
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            raise Locked(self.path) from e
        out.write(bytearray(f"{socket.gethostname()} {os.getpid()} {time.time()}\n".encode()))
        out.close()
        return self

    def __exit__(self, *_: object) -> None:
        p, fs = _hadoop(self.spark, self.path)
        fs.delete(p, False)


class RecordStore:
    """Records by batch below a folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType = AUDIT, key: str = "code_unit_id") -> None:
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key

    def read(self) -> DataFrame:
        p, fs = _hadoop(self.spark, f"{self.folder}/records")
        if not fs.exists(p) or not fs.listStatus(p):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/records")

    def pending(self, units: DataFrame, key: str = "id") -> DataFrame:
        """Units without a record of either outcome."""
        done = self.read().select(F.col(self.key).alias(key))
        return units.join(done, key, "left_anti")

    def append(self, records: DataFrame, batch: int | None = None, checked: bool = False) -> int:
        """Add a batch; a unit that is there already, or twice in the batch, is an error. Returns the batch's number.

        checked: the units come from pending() under the folder's lock, so only the batch itself is looked at and not the
        whole store with each batch.
        """
        if batch is None:
            batch = self.next_batch()
        records = records.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        path = f"{self.folder}/records/batch={batch:09d}"
        records.write.mode("overwrite").parquet(path)  # first of all: what a model said is not asked again
        own = self.spark.read.schema(self.schema).parquet(path)
        repeated = own.groupBy(self.key).agg(F.count("*").alias("n")).filter("n > 1").select(self.key)
        if not checked:
            rest = self.read().filter(~F.col("_metadata.file_path").contains(f"batch={batch:09d}/"))
            repeated = repeated.union(own.select(self.key).intersect(rest.select(self.key)))
        twice = repeated.limit(5).collect()
        if twice:
            p, fs = _hadoop(self.spark, path)
            fs.delete(p, True)
            raise Repeated(", ".join(str(r[0]) for r in twice))
        return batch

    def next_batch(self) -> int:
        p, fs = _hadoop(self.spark, f"{self.folder}/records")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")), default=-1) + 1

    def clear(self) -> None:
        """Forget all records, for a fresh run."""
        for name in ("records", "stream"):
            p, fs = _hadoop(self.spark, f"{self.folder}/{name}")
            fs.delete(p, True)

    def verify(self) -> None:
        twice = self.read().groupBy(self.key).agg(F.count("*").alias("n")).filter("n > 1").orderBy(self.key).limit(5).collect()
        if twice:
            raise Repeated(", ".join(str(r[0]) for r in twice))


PROVIDER = ("timeout", "provider_unavailable", "model_error", "provider_or_model_error")


def failing_runs(records: DataFrame, carried: int = 0, order: str = "completed_utc", key: str = "code_unit_id") -> tuple[int, int]:
    """The longest unbroken series of provider failures in order of completion, and the one at the end. carried: the series that led up to here.

    Each task sums up a range of the order, and the sums are put together one after another: a row per task.
    """
    bad = F.coalesce(F.col("failure_category").isin(*PROVIDER), F.lit(False)) & ~F.col("success")
    ordered = records.select(F.col(order).alias("at"), F.col(key).alias("key"), bad.alias("bad")).repartitionByRange("at", "key").sortWithinPartitions("at", "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, head, tail, longest = None, 0, 0, 0, 0
        for batch in batches:
            for at, key_, is_bad in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                first = first or (at or "", key_ or "")
                head += is_bad and head == n
                tail = tail + 1 if is_bad else 0
                longest, n = max(longest, tail), n + 1
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*first, n, head, tail, longest)], names=["at", "key", "n", "head", "tail", "longest"])

    most = carried
    for r in sorted(ordered.mapInArrow(run, "at string, key string, n long, head long, tail long, longest long").collect(), key=lambda r: (r.at, r.key)):
        most = max(most, carried + r.head, r.longest)
        carried = carried + r.n if r.head == r.n else r.tail
    return most, carried


def generate_stream(spark: SparkSession, source: str, schema: T.StructType, store: RecordStore, make: Callable[[DataFrame], DataFrame], key: str = "id", files_per_batch: int = 1, breaker: int = 3) -> StreamingQuery:
    """Records for all units below `source` (Parquet files, new ones as they come), each unit once.

    make: from units to records. Each micro-batch drops what is recorded, makes records of the rest and commits them; the
    query stops with Breaker after `breaker` provider failures in a row, also over the border of micro-batches, with the records made
    so far in the store.
    """
    failing = 0
    units = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def commit(batch: DataFrame, number: int) -> None:
        nonlocal failing
        path = f"{store.folder}/records/batch={number:09d}"
        p, fs = _hadoop(spark, path)
        if fs.exists(p) and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            fs.delete(p, True)  # of a write that died
        if not fs.exists(p):
            store.append(make(store.pending(batch.dropDuplicates([key]), key)), number, checked=True)
        run, failing = failing_runs(spark.read.schema(store.schema).parquet(path), failing)
        if run >= breaker:
            raise Breaker(f"{run} provider failures in a row")

    return units.writeStream.foreachBatch(commit).option("checkpointLocation", f"{store.folder}/stream").trigger(availableNow=True).start()


def pace(done: int, total: int, seconds: float) -> dict:
    """Units a minute, and the seconds that the rest will take at that rate; null before the first unit."""
    rate = done / seconds if done and seconds > 0 else None
    return {"done": done, "total": total, "units_per_minute": rate and round(rate * 60, 2), "eta_s": rate and round((total - done) / rate, 1)}


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and rates of each micro-batch so far."""
    return [{"batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond} for p in query.recentProgress]
