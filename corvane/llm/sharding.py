"""A store of immutable shards with size-tiered compaction and versioned manifests.

Layout below the store's path:

    data/<run>/...parquet        shards; never changed once written
    pending/<run>                a marker for as long as a writer works on a run
    manifests/<run>/...parquet   lists of shards: (file below data/, bytes, rows)
    commits/<version>            a small JSON file that names one manifest

An arrival is written as it comes, one small shard per task and no shuffle. Compaction sorts shards below the target into
tiers of similar size (each tier spans a factor of `fanout`); a tier of at least `fanout` shards is packed into runs of about the
target size, each of which one task writes as one file. A version exists from the moment its commit file is renamed into
place, which fails if another writer was first: readers see the old list or the new one, and files of jobs that died are
in no list.

Writers don't wait for one another. An arrival is committed on top of whatever is newest. A merge is committed only on a version that
still lists each file that it replaces; if another compaction took one of them, what the merge wrote is dropped and the rest
is planned again, so no row is lost or doubled. `vacuum` spares runs with a marker and versions that were current lately.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import islice

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, empty, free_name, shared_path, table

MANIFEST = "file string, bytes long, rows long"
#: Rows of a table that are numbered in one task.
NUMBERED = 1000


class CommitConflict(RuntimeError):
    """Another writer published the version first."""


class StalePlan(RuntimeError):
    """Shards of a plan are no longer listed; another compaction replaced them."""


def _below_data(path: Column) -> Column:
    return F.regexp_extract(path, r"/data/([0-9a-f]{32}/.*)$", 1)


@dataclass(frozen=True)
class Tiering:
    """target: bytes of a full file. fanout: shards that make a tier worth merging, and the span of sizes in a tier."""

    target: int = 64 << 20
    fanout: int = 4
    packing: int = 64  # targets' worth of shards that are packed together at once
    waves: int = 4  # parts in which a round of merges is done, at least
    wave_files: int = 10_000  # shards in a wave, about: their names pass through the driver


class ShardStore:
    """Versioned shards below a path that all machines share. Any schema of uniquely named columns will do."""

    def __init__(self, spark: SparkSession, path: str, tiering: Tiering = Tiering()) -> None:
        self.spark, self.path, self.tiering = spark, path.rstrip("/"), tiering

    # ------------------------------------------------------------ commits

    def _fs(self):
        jvm = self.spark._jvm
        to = jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        return to, to(self.path).getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(to(self.path).toUri(), conf)

    def version(self) -> int:
        """The newest version; 0 if nothing was committed yet."""
        path, fs, _ = self._fs()
        folder = path(f"{self.path}/commits")
        if not fs.exists(folder):
            return 0
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return max((int(x) for x in names if x.isdigit()), default=0)

    def commit_info(self, version: int | None = None) -> dict:
        """{version, manifest, schema, files, bytes, rows} of a version, by default the newest."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "manifest": None, "schema": None, "files": 0, "bytes": 0, "rows": 0}
        path, fs, _ = self._fs()
        stream = fs.open(path(f"{self.path}/commits/{version:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, after: int, manifest: DataFrame, schema: T.StructType) -> int:
        """Write a manifest and rename its commit file into place as version after + 1."""
        folder = f"manifests/{uuid.uuid4().hex}"
        manifest.write.parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{folder}")
        total = written.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        info = {"version": after + 1, "manifest": folder, "schema": schema.jsonValue(), "files": total[0], "bytes": total[1], "rows": total[2]}
        path, fs, context = self._fs()
        fs.mkdirs(path(f"{self.path}/commits"))
        draft, final = path(f"{self.path}/commits/_{uuid.uuid4().hex}"), path(f"{self.path}/commits/{after + 1:012d}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(info).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if fs.exists(final):
                raise CommitConflict(f"version {after + 1} exists") from error
            raise
        return after + 1

    # ------------------------------------------------------------ reading

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version: (file, bytes, rows)."""
        info = self.commit_info(version)
        if info["manifest"] is None:
            return empty(self.spark, T.StructType.fromDDL(MANIFEST))
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{info['manifest']}")

    def _files(self, run: str, schema: T.StructType) -> DataFrame:
        """Rows of one run; partition folders are no columns."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/data/{run}")

    def _list(self, run: str, schema: T.StructType) -> DataFrame:
        """(file, bytes, rows) of the shards that a run wrote, from the files' own footers. Empty files are no shards."""
        rows = self._files(run, schema).select(_below_data(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return rows.groupBy("file", "bytes").agg(F.count("*").alias("rows")).select("file", "bytes", "rows")

    def read(self, version: int | None = None, file_col: str = "shard") -> DataFrame:
        """All rows of a version and the name of each one's shard."""
        version = self.version() if version is None else version
        info = self.commit_info(version)
        if info["schema"] is None:
            raise ValueError("the store is empty")
        schema = T.StructType.fromJson(info["schema"])
        name = free_name(empty(self.spark, schema), file_col)
        listed = self.manifest(version)
        runs = [r.run for r in listed.select(F.substr("file", F.lit(1), F.lit(32)).alias("run")).distinct().collect()]
        if not runs:
            return empty(self.spark, schema).withColumn(name, F.lit(None).cast("string"))
        rows = self._below(sorted(runs), schema)
        there = len(rows._jdf.inputFiles())  # counted in the JVM, where the reader lists the files anyway
        rows = rows.select("*", _below_data(F.col("_metadata.file_path")).alias(name))
        if there != info["files"]:  # a run of this version also holds shards that later compactions replaced
            rows = rows.join(listed.select(F.col("file").alias(name)), name, "left_semi")
        return rows.select(*schema.names, name)

    def _below(self, names: list[str], schema: T.StructType) -> DataFrame:
        """Rows of runs or files below data/."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/data/{x}" for x in names])

    # ------------------------------------------------------------ writing

    @contextmanager
    def _run(self) -> Iterator[str]:
        """The name of a new run, marked as pending until it is committed or given up."""
        path, fs, _ = self._fs()
        run = uuid.uuid4().hex
        marker = path(f"{self.path}/pending/{run}")
        fs.create(marker, False).close()
        try:
            yield run
        finally:
            fs.delete(marker, False)

    def _alive(self, run: str) -> None:
        path, fs, _ = self._fs()
        if not fs.exists(path(f"{self.path}/pending/{run}")):
            raise RuntimeError("this writer took so long that a vacuum gave it up; nothing was committed")

    def append(self, df: DataFrame, arrivals: int = 1) -> int:
        """Write an arrival as small shards, one per task, and commit it; returns the version.

        With `arrivals` the rows of each task are dealt out in turn and come in as so many arrivals, each a version of its own;
        they are still written in one pass. An empty arrival makes a version with no new shard. Appends commute: on a conflict the commit is tried again on top of the newer version. The schema
        must be that of the store.
        """
        schema = T.StructType.fromJson(df.schema.jsonValue())
        for f in schema.fields:
            f.nullable = True
        info = self.commit_info()
        if info["schema"] is not None and [(f["name"], f["type"]) for f in info["schema"]["fields"]] != [(f["name"], f["type"]) for f in schema.jsonValue()["fields"]]:
            raise ValueError("the arrival's schema differs from the store's")
        version = 0
        with self._run() as run:
            if arrivals > 1:
                part = free_name(df, "arrival")
                df.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(arrivals))).write.partitionBy(part).parquet(f"{self.path}/data/{run}")
                new = cut(self._list(run, schema))  # a row per shard
                parts = [new.filter(F.col("file").contains(f"/{part}={k}/")) for k in range(arrivals)]
            else:
                df.write.parquet(f"{self.path}/data/{run}")
                parts = [self._list(run, schema)]
            for own in parts:
                while True:
                    self._alive(run)
                    at = self.version()
                    try:
                        version = self._publish(at, self.manifest(at).unionByName(own), schema)
                        break
                    except CommitConflict:
                        continue
        return version

    def plan(self, version: int | None = None) -> DataFrame:
        """(file, bytes, rows, run) of shards to merge: shards with the same run become one file of about the target size.

        A tier is packed in parts of a bounded number of shards, so no task sees all shards of the store. The rest of a part, at
        most one run per part, is merged too. A run of one shard stays as it is.
        """
        t = self.tiering
        small = self.manifest(version).filter(F.col("bytes") < t.target / 2)
        tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(4096)) / F.lit(4096.0)) / F.log(F.lit(float(t.fanout))))
        small = small.withColumn("tier", tier)
        tiers = small.groupBy("tier").agg(F.count("*").alias("shards"), F.sum("bytes").alias("all")).filter(F.col("shards") >= t.fanout)
        small = small.join(tiers, "tier").withColumn("part", F.pmod(F.xxhash64("file"), F.ceil(F.col("all") / F.lit(t.packing * t.target))))
        before = F.sum("bytes").over(Window.partitionBy("tier", "part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
        runs = F.concat_ws("-", "tier", "part", F.floor(F.coalesce(before, F.lit(0)) / t.target))
        return small.select("file", "bytes", "rows", runs.alias("run"))

    def compact(self, reclaim: bool = False, max_rounds: int = 20) -> int:
        """Merge until no tier has `fanout` shards below half the target; returns the version. Rows stay as they are.

        A round goes in a few waves, each with a commit of its own. Other writers may append and compact meanwhile: a wave whose
        files they replaced is planned again. With `reclaim` the shards that a wave replaced are deleted after its commit,
        so a compaction needs room for a wave instead of the whole store. That is for a store that nobody else reads: readers of
        older versions lose their files. Without it, `vacuum` deletes them later.
        """
        for _ in range(max_rounds):
            plan = cut(self.plan())
            runs = _numbered(plan.groupBy("run").agg(F.count("*").alias("shards")).filter("shards > 1"), "run")
            n, shards = runs.agg(F.count("*"), F.sum("shards")).first()
            if not n:
                return self.version()
            waves = min(n, max(self.tiering.waves, -(-shards // self.tiering.wave_files)))
            for wave in range(waves):
                own = runs.filter(F.col("number") % waves == wave).select("run", F.floor(F.col("number") / waves).cast("int").alias("slot"))
                files = plan.join(own, "run").select("file", "rows", "slot")
                try:
                    self._merge(files, len(range(wave, n, waves)))
                except StalePlan:
                    break
                if reclaim:
                    self._delete(r.file for r in files.select("file").toLocalIterator())
        return self.version()

    def _stale(self, files: DataFrame, listed: DataFrame) -> bool:
        return not files.select("file").join(listed, "file", "left_anti").isEmpty()

    def _merge(self, plan: DataFrame, runs: int) -> int:
        """Write one file for each slot of the plan (file, rows, slot) and commit it in place of the plan's files.

        StalePlan if a version came up that doesn't list all of them; nothing is committed then.
        """
        schema = T.StructType.fromJson(self.commit_info()["schema"])
        with self._run() as out:
            try:
                self._write_merged(plan, runs, schema, out)
            except (PySparkException, Py4JJavaError) as error:  # a file may be gone under the reader
                self._drop(out)
                if self._stale(plan, self.manifest()):
                    raise StalePlan from error
                raise
            new = cut(self._list(out, schema))  # a row per merged file
            lost = plan.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] - new.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
            if lost:
                raise RuntimeError(f"a merge lost {lost} rows; nothing was committed")
            while True:
                self._alive(out)
                at = self.version()
                listed = self.manifest(at)
                if self._stale(plan, listed):
                    self._drop(out)
                    raise StalePlan
                try:
                    return self._publish(at, listed.join(plan.select("file"), "file", "left_anti").select("file", "bytes", "rows").unionByName(new), schema)
                except CommitConflict:
                    continue

    def _write_merged(self, plan: DataFrame, runs: int, schema: T.StructType, out: str) -> None:
        none = empty(self.spark, schema)
        key, file = free_name(none, "merge_run"), free_name(none, "merge_file")
        names = [r.file for r in plan.select("file").collect()]  # of one wave
        placed = plan.join(_placement(self.spark, runs), "slot").select(F.col("file").alias(file), F.col("place").alias(key))
        if len(names) <= 4 * self.tiering.wave_files:  # some hundred bytes each; a tier of very small shards may make larger waves
            placed = F.broadcast(placed)
        rows = self._below(names, schema).select("*", _below_data(F.col("_metadata.file_path")).alias(file)).join(placed, file).drop(file)
        rows.repartition(runs, key).write.partitionBy(key).parquet(f"{self.path}/data/{out}")

    def _drop(self, run: str) -> None:
        path, fs, _ = self._fs()
        fs.delete(path(f"{self.path}/data/{run}"), True)

    def _delete(self, files: Iterable[str]) -> int:
        """Delete shards, several at once; their names pass through the driver but aren't held there. Returns how many."""
        path, fs, _ = self._fs()
        names, done = iter(files), 0
        with ThreadPoolExecutor(16) as pool:
            while some := list(islice(names, 1000)):
                done += sum(pool.map(lambda x: bool(fs.delete(path(f"{self.path}/data/{x}"), False)), some))
        return done

    def vacuum(self, retain: float = 3600.0, expire: float = 7 * 86400.0) -> int:
        """Delete shards that no retained version lists, and runs without any; returns how many shards went.

        retain: versions that were the newest within so many seconds stay readable; older ones don't. Runs that a writer is at
        work on are left alone, unless their marker is older than `expire` seconds: that writer counts as dead and
        will not be able to commit.
        """
        path, fs, _ = self._fs()
        # in this order: a run that was there and is not pending any more has been committed, or given up, before the version is read
        folders = [x.getPath().getName() for x in fs.listStatus(path(f"{self.path}/data"))]
        listing = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/data")
        there = cut(listing.select(_below_data(F.col("path")).alias("file")))
        now, busy = time.time(), []
        for x in fs.listStatus(path(f"{self.path}/pending")) if fs.exists(path(f"{self.path}/pending")) else []:
            if now - x.getModificationTime() / 1000 > expire:
                fs.delete(x.getPath(), False)
            else:
                busy.append(x.getPath().getName())
        version = self.version()
        live = self.manifest(version).select("file")
        since = self._committed(version)
        while version > 1 and now - since < retain:
            version, since = version - 1, self._committed(version - 1)
            live = live.unionByName(self.manifest(version).select("file"))
        live = cut(live.distinct())
        kept = {*busy, *(r.run for r in live.select(F.substr("file", F.lit(1), F.lit(32)).alias("run")).distinct().collect())}
        gone = cut(there.filter(~F.substr("file", F.lit(1), F.lit(32)).isin(*busy) if busy else F.lit(True)).join(live, "file", "left_anti"))
        n = gone.count()
        for run in folders:
            if run not in kept:
                self._drop(run)
        rest = gone.filter(F.substr("file", F.lit(1), F.lit(32)).isin(*kept)) if kept else gone.limit(0)
        self._delete(r.file for r in rest.toLocalIterator())
        return n

    def _committed(self, version: int) -> float:
        """When a version was committed, in seconds; 0 for the empty store."""
        path, fs, _ = self._fs()
        return fs.getFileStatus(path(f"{self.path}/commits/{version:012d}")).getModificationTime() / 1000 if version else 0.0


def _numbered(df: DataFrame, key: str, number: str = "number") -> DataFrame:
    """df, whose `key` is unique, with numbers 0, 1, ...; a task numbers about NUMBERED rows, another the tasks."""
    part = free_name(df, "number_part")
    parts = F.pmod(F.xxhash64(key), F.lit(max(1, df.count() // NUMBERED)))
    df = cut(df.withColumn(part, parts))
    before = df.groupBy(part).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return cut(df.join(before, part).withColumn(number, F.row_number().over(Window.partitionBy(part).orderBy(key)) - 1 + F.col("before")).drop(part, "before"))


def _placement(spark: SparkSession, n: int) -> DataFrame:
    """(slot, place) for n slots: numbers whose hash deals each slot to a partition of its own out of n."""
    tried = spark.range(int(n * (20 + 2 * math.log(n + 1)))).select(F.col("id").cast("int").alias("id"))
    return tried.groupBy(F.pmod(F.hash("id"), F.lit(n)).cast("int").alias("slot")).agg(F.min("id").alias("place"))


def shard(docs: DataFrame, tiering: Tiering = Tiering(), path: str | None = None, arrivals: int = 4) -> DataFrame:
    """Store docs in some arrivals, compact the store and return all its rows with the columns `shard` and `version`.

    Rows come back as they were, nulls, repeated and empty ones too. path: of the store, by default a new one, whose replaced shards are
    deleted at once; in a store that was named they stay for its other readers until a vacuum.
    """
    store = ShardStore(docs.sparkSession, path or shared_path(docs.sparkSession, "shards"), tiering)
    store.append(docs, arrivals)
    version = store.compact(reclaim=path is None)
    if path is None:
        store.vacuum(retain=0)
    rows = store.read(version)
    return rows.withColumn(free_name(rows, "version"), F.lit(version).cast("long"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard after its four arrivals were merged."""
    docs = table(spark, sf_dir, "documents")
    return shard(docs).select("doc_id", "shard", "version", F.octet_length("text").cast("long").alias("n_bytes"))


ORACLE: dict[str, str] = {}
QUERIES = {"op5_sharding": op5_sharding}
