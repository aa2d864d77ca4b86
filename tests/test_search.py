"""Exact search: what a worker holds, and its results against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluate


def worker(spark, monkeypatch, n, size):
    """What top_k() runs in a worker for n queries."""
    found, kind = [], type(spark.range(0))
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: found.append(f) or real(self, f, *a, **b))
    queries = spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(1000)) / 1000.0).alias("embedding"))
    evaluate.top_k(queries, queries)
    assert len(found) == 1
    return found[0]


@pytest.mark.parametrize("same", [False, True])
def test_temporaries_stay_small_whatever_is_sent(spark, monkeypatch, same):
    run, rng = worker(spark, monkeypatch, 1500, 8), np.random.default_rng(3)
    vectors = np.ones((4096, 8)) if same else rng.random((4096, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4096) + 10_000), pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * 4096 + 1, 8, dtype=np.int32)), pa.array(vectors.ravel()))], names=["id", "v"])
    list(run([batch.slice(0, 1)]))  # what was sent is read
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run([batch]))
        mb = tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()
    assert rows == 15_000 and mb < 40, mb


def test_tiles_leave_the_results_as_they_are(spark, monkeypatch):
    """More queries than a tile holds, with ties and copies; queries are rows of the corpus."""
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (3000, 4)).astype(float)
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = evaluate.top_k(corpus, corpus.filter("vec_id % 9 = 0"), k=5, metric=("dot", "l2")).collect()
    found = {m: {(r.query_id, r["rank"]): r.vec_id for r in got if r.metric == m} for m in ("dot", "l2")}
    asked = range(0, 3000, 9)
    assert len(got) == 2 * 5 * len(asked)
    for q in asked:
        for m, score in (("dot", vectors @ vectors[q]), ("l2", -((vectors - vectors[q]) ** 2).sum(axis=1))):
            order = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:5]
            assert [found[m][q, r] for r in range(1, 6)] == order


def test_only_the_search_starts_workers(spark):
    """Whether there are queries or not, no plan has an RDD of Python rows."""
    rows = spark.range(3).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    none, some = evaluate.top_k(rows, rows.limit(0)), evaluate.top_k(rows, rows)
    assert none.dtypes == some.dtypes == [("query_id", "bigint"), ("vec_id", "bigint"), ("rank", "bigint")]
    assert none.count() == 0 and some.count() == 6
    for df in (none, some):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()
