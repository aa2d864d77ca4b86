"""Poisson replication against a plain Python draw."""

import hashlib

import pytest

from corvane.llm.mixing import Mixture, mix, op2_mix, poisson_cdf, rates, replicate


def copies(key, cdf, seed=42):
    u = (int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return sum(c < u for c in cdf)


def brute(rows, weight):
    n = {}
    for _, s in rows:
        n[s] = n.get(s, 0) + 1
    w = {s: weight(s, c) for s, c in n.items()}
    total = sum(w.values())
    out = {}
    for i, s in rows:
        rate = w[s] / total * len(rows) / n[s] if total else 0.0
        for k in range(copies("null" if i is None else i, poisson_cdf(rate))):
            out[i, s, k + 1] = out.get((i, s, k + 1), 0) + 1
    return out


def found(df):
    out = {}
    for r in df.collect():
        out[r.doc_id, r.source, r.copy] = out.get((r.doc_id, r.source, r.copy), 0) + 1
    return out


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op2_mix(spark, sf_dir)
    assert found(got) == brute(rows, lambda s, n: n**0.5)
    keys = [r.shuffle_key for r in got.collect()]
    assert keys == sorted(keys) and keys[0] == hashlib.md5(f"{got.first().doc_id}:{got.first().copy}:42:order".encode()).hexdigest()


@pytest.mark.parametrize("most", [2000, 0])
def test_weights_nulls_and_repeats(spark, most):
    rows = [(i, ["a", "b", "c", None][i % 4]) for i in range(400)] + [(None, "a"), (None, None), (3, None), (3, None)]
    weights = {"a": 5.0, "b": 0.0, None: 1.0}
    df = spark.createDataFrame([(i, s, 1) for i, s in rows], "doc_id long, source string, mix_rate int")
    got = replicate(df, Mixture(weights=weights, max_sources=most))
    assert found(got) == brute(rows, lambda s, n: weights.get(s, 0.0))
    assert got.columns == ["doc_id", "source", "mix_rate", "n_copies", "copy"]
    mixed = mix(df, Mixture(weights=weights, max_sources=most))
    assert mixed.columns == df.columns and mixed.count() == got.count()


def test_expected_size(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "if(id % 10 < 7, 'big', 'small') as source")
    got = mix(df, Mixture(weights={"big": 1, "small": 3}, size=10000))
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["big"] - 2500) < 250 and abs(n["small"] - 7500) < 430
    assert {r.source: round(r.rate, 6) for r in rates(df).collect()}.keys() == {"big", "small"}


def test_empty_and_zero(spark):
    df = spark.createDataFrame([], "doc_id long, source string")
    assert mix(df).collect() == []
    assert mix(spark.createDataFrame([(1, "a")], df.schema), Mixture(weights={"x": 1.0})).collect() == []


def test_whole_documents_are_mixed(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op2_mix(spark, sf_dir)
    keys = []
    for file in sorted(got.inputFiles()):  # parts are named in the order of the rows
        stored = spark.read.parquet(file).collect()
        assert all(all(r[c] == docs[r.doc_id][c] for c in docs[r.doc_id].asDict()) for r in stored)
        keys += [r.shuffle_key for r in stored]
    assert keys and keys == [r.shuffle_key for r in got.collect()]


@pytest.mark.parametrize("most", [2000, 0])
def test_large_rates(spark, most):
    weights = {"a": 700.0, "b": 800.0, None: 5000.0, "d": 0.5}
    names = list(weights)
    df = spark.createDataFrame([(i, names[i % 4]) for i in range(24)], "doc_id long, source string")
    p = Mixture(weights=weights, size=int(6 * sum(weights.values())), max_sources=most)
    got = {r.doc_id: r.n_copies for r in replicate(df, p).select("doc_id", "n_copies").distinct().collect()}
    rate = {r.source: r.rate for r in rates(df, p).collect()}
    want = {i: copies(i, poisson_cdf(rate[names[i % 4]])) for i in range(24)}
    assert got == {i: n for i, n in want.items() if n}
    assert all(abs(n - rate[names[i % 4]]) < 6 * rate[names[i % 4]] ** 0.5 + 6 for i, n in want.items())


@pytest.mark.parametrize("most", [2000, 0])
def test_clashing_names(spark, most):
    names = ["__copy", "__n_copies", "__shuffle_key", "copy", "n_copies", "shuffle_key", "mix_source", "mix_cdf"]
    df = spark.createDataFrame([(i, "ab"[i % 2], *(f"{c}{i}" for c in names)) for i in range(200)], "doc_id long, source string, " + ", ".join(f"{c} string" for c in names))
    p = Mixture(weights={"a": 3.0, "b": 1.0}, max_sources=most)
    plain = [r.doc_id for r in mix(df.select("doc_id", "source"), p).collect()]
    got = mix(df, p)
    rows = got.collect()
    assert got.columns == df.columns and [r.doc_id for r in rows] == plain  # the same order as without them
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
    assert replicate(df, p).columns == [*df.columns, "_n_copies", "_copy"]
