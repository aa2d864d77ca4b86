"""What Python workers hold: rows and temporaries of bounded size, and no workers where there is nothing to compute."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from corvane.llm import common, decontaminate, near_dup
from corvane.llm.sharding import ShardStore


def peak(work):
    common._powers.clear()
    tracemalloc.start()
    try:
        n = work()
        return n, tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_temporaries_of_a_large_batch_stay_small():
    words = np.random.default_rng(5).integers(0, 50_000, (2000, 300))
    texts = pa.array([" ".join(f"w{x}" for x in row) for row in words], pa.string())
    assert texts.nbytes > 3 << 20
    shingles, mb = peak(lambda: sum(len(u) for u in near_dup._sets(texts, 5)))
    assert shingles == 2000 * 296 and mb < 30
    found, mb = peak(lambda: sum(len(hashes) for _, hashes, _ in decontaminate._words(texts)))
    assert found == 2000 * 300 and mb < 30


def test_every_row_comes_once_and_few_at_a_time():
    rows, sizes = list(range(3 * common.ROWS + 7)), []

    def run(batches):
        for batch in batches:
            sizes.append(batch.num_rows)
            yield batch

    whole = pa.RecordBatch.from_arrays([pa.array(rows)], names=["x"])
    got = [x for b in common.lean(run)([whole, whole.slice(0, 0), whole.slice(5, 1)]) for x in b.column(0).to_pylist()]
    assert got == [*rows, 5] and max(sizes) == common.ROWS


def test_empty_tables_start_no_worker(spark, tmp_path):
    schema = T.StructType.fromDDL("doc_id long, tags array<string>, `a.b` struct<c: double>")
    none = common.empty(spark, schema)
    assert none.dtypes == [("doc_id", "bigint"), ("tags", "array<string>"), ("a.b", "struct<c:double>")] and none.count() == 0
    manifest = ShardStore(spark, str(tmp_path)).manifest()
    assert manifest.dtypes == [("file", "string"), ("bytes", "bigint"), ("rows", "bigint")] and manifest.count() == 0
    for df in (none, manifest):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()
