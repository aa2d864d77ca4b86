"""The shard store: exact round trips, tiers, versions and conflicts."""

import math
import time
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import sharding
from corvane.llm.common import shared_path
from corvane.llm.sharding import CommitConflict, ShardStore, Tiering, op5_sharding, shard


def bag(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_documents_come_back_once_in_merged_shards(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = Counter((r.doc_id, len((r.text or "").encode()) if r.text is not None else None) for r in docs.collect())
    got = op5_sharding(spark, d).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == want
    assert {r.version for r in got} == {5} and len({r.shard for r in got}) == 1  # four arrivals, one merge
    kept = shard(docs, Tiering(target=200_000, fanout=3), arrivals=6)
    assert bag(kept, docs.columns) == bag(docs, docs.columns)


def packed(rows, t):
    """The plan, shard by shard: {file: run} of what is to be merged."""
    small = defaultdict(list)
    for r in rows:
        if r.bytes < t.target / 2:
            small[math.floor(math.log(max(r.bytes, 4096) / 4096.0) / math.log(t.fanout))].append(r)
    out = {}
    for tier, own in small.items():
        if len(own) < t.fanout:
            continue
        parts = math.ceil(sum(r.bytes for r in own) / (t.packing * t.target))
        at = Counter()
        for r in sorted(own, key=lambda r: r.file):
            h = xxhash.xxh64(r.file.encode(), seed=42).intdigest()
            part = (h - (h >> 63 << 64)) % parts
            out[r.file] = (tier, part, at[part] // t.target)
            at[part] += r.bytes
    return out


def test_packing_is_that_of_a_plain_loop(spark):
    tiering = Tiering(target=60_000, fanout=3, packing=2)
    store = ShardStore(spark, shared_path(spark, "test"), tiering)
    rows = spark.range(3000).selectExpr("id as doc_id", "repeat(md5(cast(id as string)), 1 + cast(id % 5 as int)) as text")
    store.append(rows.repartition(20))
    store.append(rows.filter("doc_id % 3 = 0").repartition(9))
    store.append(rows.filter("doc_id < 0"))
    plan = {r.file: r.run for r in store.plan().collect()}
    want = packed(store.manifest().collect(), tiering)
    assert len(want) > 20 and len(set(want.values())) > 3
    groups = lambda x: {frozenset(f for f in x if x[f] == run) for run in set(x.values())}
    assert groups(plan) == groups(want)
    held = defaultdict(set)  # shard -> ids before; a merged file holds just what its run's files held
    for r in store.read().select("shard", "doc_id").collect():
        held[r.shard].add(r.doc_id)
    sizes = Counter()
    for files in groups(want):
        if len(files) > 1:
            sizes[frozenset().union(*(held[f] for f in files))] += 1
    at = store.version()
    first = Tiering(target=60_000, fanout=3, packing=2, waves=1)
    ShardStore(spark, store.path, first).compact(max_rounds=1)
    assert store.version() == at + 1
    after = defaultdict(set)
    for r in store.read().select("shard", "doc_id").collect():
        after[r.shard].add(r.doc_id)
    assert Counter(frozenset(x) for f, x in after.items() if f not in held) == sizes


def test_compaction_within_a_compaction(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("id as doc_id", "repeat(md5(cast(id as string)), 3) as text")
    for other in ("compact", "append", "reclaim"):
        store = ShardStore(spark, shared_path(spark, "test"), Tiering(target=40_000, fanout=3))
        store.append(rows, arrivals=4)
        plain, within = ShardStore._write_merged, []

        def racing(self, *args, other=other, store=store, plain=plain, within=within):
            if not within:  # another writer is faster, once
                within.append(1)
                rival = ShardStore(spark, store.path, store.tiering)
                if other == "append":
                    rival.append(rows.limit(0).union(spark.createDataFrame([(-1, "late")], rows.schema)))
                else:
                    rival.compact(reclaim=other == "reclaim")
            return plain(self, *args)

        monkeypatch.setattr(ShardStore, "_write_merged", racing)
        store.compact()
        monkeypatch.setattr(ShardStore, "_write_merged", plain)
        assert within
        want = bag(rows, rows.columns) + Counter({(-1, "late"): 1} if other == "append" else {})
        assert bag(store.read(), rows.columns) == want
        assert store.commit_info()["rows"] == sum(want.values())


def test_vacuum_within_an_append(spark, monkeypatch):
    store = ShardStore(spark, shared_path(spark, "test"), Tiering(target=40_000, fanout=3))
    rows = spark.range(300).selectExpr("id as doc_id", "md5(cast(id as string)) as text")
    store.append(rows.repartition(4))
    plain = ShardStore._publish

    def racing(self, *args):
        monkeypatch.setattr(ShardStore, "_publish", plain)
        assert ShardStore(spark, store.path).vacuum(retain=0) == 0
        return plain(self, *args)

    monkeypatch.setattr(ShardStore, "_publish", racing)
    store.append(rows.repartition(3))
    assert bag(store.read(), rows.columns) == bag(rows.union(rows), rows.columns)
    before = store.version()
    store.compact()
    assert store.vacuum() == 0 and bag(store.read(before), rows.columns) == bag(rows.union(rows), rows.columns)  # readers have an hour
    assert store.vacuum(retain=0) == 7 and bag(store.read(), rows.columns) == bag(rows.union(rows), rows.columns)

    def dead(self, run):
        path, fs, _ = self._fs()
        time.sleep(0.1)
        ShardStore(spark, store.path).vacuum(retain=0, expire=0)
        assert not fs.exists(path(f"{self.path}/data/{run}"))
        return alive(self, run)

    alive = ShardStore._alive
    monkeypatch.setattr(ShardStore, "_alive", dead)
    with pytest.raises(RuntimeError, match="gave it up"):
        store.append(rows)
    monkeypatch.setattr(ShardStore, "_alive", alive)
    assert store.read().count() == 600


def test_numbers(spark, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED", 10)
    got = sharding._numbered(spark.range(137).withColumn("run", F.md5(F.col("id").cast("string"))), "run").collect()
    assert sorted(r.number for r in got) == list(range(137)) and len({r.run for r in got}) == 137
    assert sharding._numbered(spark.range(0).withColumn("run", F.lit("")), "run").collect() == []


def test_tiers_merge_and_versions_stay(spark):
    store = ShardStore(spark, shared_path(spark, "test"), Tiering(target=60_000, fanout=3))
    rows = spark.range(4000).selectExpr("id as doc_id", "repeat(md5(cast(id as string)), 3) as text", "if(id % 7 = 0, null, 'x') as shard", "cast(null as int) as version")
    want = Counter()
    for part in range(5):
        own = rows.filter(f"doc_id % 5 = {part}").repartition(4)
        want += bag(own, own.columns)
        assert store.append(own) == part + 1
    assert store.commit_info()["files"] == 20 and store.commit_info()["rows"] == 4000
    before = store.version()
    after = store.compact()
    assert after > before
    got = store.read()
    assert bag(got, rows.columns) == want and bag(store.read(before), rows.columns) == want and bag(store.read(2), rows.columns) == bag(rows.filter("doc_id % 5 < 2"), rows.columns)
    sizes = [r.bytes for r in store.manifest().collect()]
    assert len(sizes) < 20 and max(sizes) < 3 * 60_000
    assert store.compact() == after  # nothing is left to do
    assert store.vacuum(retain=0) >= 5 and bag(store.read(), rows.columns) == want
    assert got.columns == [*rows.columns, "_shard"]


def test_conflicts(spark):
    store = ShardStore(spark, shared_path(spark, "test"))
    df = spark.range(10)
    store.append(df)
    with pytest.raises(CommitConflict):
        store._publish(0, store.manifest(), df.schema)
    assert store.version() == 1 and store.read().count() == 10
    with pytest.raises(ValueError):
        store.append(df.selectExpr("cast(id as string) as id"))


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shard(df).collect() == []
    rows = [(1, "a"), (1, "a"), (None, None), (2, "x" * 500_000)]
    assert bag(shard(spark.createDataFrame(rows, df.schema)), df.columns) == Counter(rows)
    with pytest.raises(ValueError):
        ShardStore(spark, shared_path(spark, "test")).read()
