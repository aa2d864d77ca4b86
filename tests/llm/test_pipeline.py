"""The pipeline's stages, each held against what the operators say of its own input, and the whole run."""

from collections import Counter

import numpy as np
import pyarrow as pa
import test_mixing
import test_near_dup
import test_quality

import corpus_pipeline
from corvane.llm import decontaminate, mixing, near_dup, quality


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [name for name, _ in corpus_pipeline.STAGES]
    assert kept == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        ids = Counter(r.doc_id for r in got)
        if name != "shard":
            assert out.columns == docs.columns
        texts = {r.doc_id: r.text for r in rows}
        assert all(r.text == texts[r.doc_id] for r in got)
        if name == "quality":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            verdict = quality.judge(docs, quality.cutoffs(docs, labels)).collect()
            want = Counter(r.doc_id for r in verdict if r.quality.kept)
        elif name == "near_dedup":
            want = Counter(r.id for r in near_dup.near_duplicates(docs, corpus_pipeline.NEAR).collect() if r.kept)
        elif name == "decontaminate":
            bad = {r.id for r in decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            want = Counter(r.doc_id for r in rows if r.doc_id not in bad)
            assert bad
        elif name == "mix":
            want = Counter(r.doc_id for r in mixing.replicate(docs).collect())
        else:
            want = Counter(r.doc_id for r in rows)
        assert ids == want and 0 < len(ids)
        docs = spark.createDataFrame(got, out.schema) if name != "shard" else docs


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "version"]
    assert out.count() > 100


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(e.oracle_sql()) <= set(names)


def contained(text, items, p=decontaminate.Decontamination()):
    """Whether the alignment over the whole text, without seeds, accepts an item."""
    of = lambda t: next((w for _, w, _ in decontaminate._words(pa.array([t or ""], pa.string()))), np.zeros(0, np.uint64))
    words = of(text)
    return any(len(w) and decontaminate.align(w, words, p)[0] >= p.score * p.match * len(w) for w in map(of, items))


def test_stages_against_brute_force(spark, sf_dir):
    """Every stage on what the one before kept, held against loops over all rows, pairs and items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf_dir)
        if name == "quality":
            limits = test_quality.chosen_by_loops([(r[0], r[2], r[1]) for r in rows], labels, 0.02, 0.05)
            want = [r for r in rows if not test_quality.base(r[1]) and not any(test_quality.rule_values(r[1])[rule] > c for (lang, rule), c in limits.items() if lang == r[2])]
        elif name == "near_dedup":
            found = test_near_dup.brute([(r[0], r[1]) for r in rows], 5, 80)
            want = [r for r in rows if found[r[0]][1] == r[0]]
        elif name == "decontaminate":
            want = [r for r in rows if not contained(r[1], items)]
        elif name == "mix":
            copies = Counter()
            for (i, _, _), n in test_mixing.brute([(r[0], r[3]) for r in rows], lambda s, n: n**0.5).items():
                copies[i] += n
            want = [r for r in rows for _ in range(copies[r[0]])]
        else:
            want = rows
            assert out.columns == [*docs.columns, "shard", "version"]
        got = [tuple(r)[:5] for r in out.collect()]
        assert Counter(got) == Counter(want), name
        assert name in ("mix", "shard") or len(want) < len(rows), name
        rows, now = want, spark.createDataFrame(want, docs.schema)


def test_stages_on_edge_rows(spark, sf_dir):
    """Nulls in any column, empty and repeated rows, repeated ids, ties, clashing columns and empty tables."""
    text = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"term{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1, "a"), (1, text, "en", "s", 1, "a"), (5, text, "en", "s", 1, "b"), (5, other, None, None, None, None), (None, text, None, None, None, "c"), (7, None, "en", "s", 0, "d"), (8, "", "en", "s", 0, "e"), (9, other, "en", "t", 2, "f")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ["__gone", "quality", "gone_id", "copy", "shard", "text_words", "__copy"]
    docs = spark.createDataFrame([(*r, *[r[5]] * (len(clash) - 1)) for r in rows], f"{schema}, " + ", ".join(f"`{c}` string" for c in clash))
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name, df=docs: sorted(str(r["__gone"]) for r in stages[name](spark, df, sf_dir).collect())
    assert kept("quality") == ["None", "a", "a", "b", "c", "f"]
    assert kept("near_dedup") == ["None", "a", "a", "c", "d", "e"]  # 5's own text stays, its copy of 1 and 9's copy of that go
    assert kept("decontaminate") == sorted(str(r[5]) for r in rows)
    assert kept("shard") == sorted(str(r[5]) for r in rows)
    for name in stages:
        assert stages[name](spark, docs.limit(0), sf_dir).count() == 0
        out = stages[name](spark, docs, sf_dir)
        assert out.columns[: len(docs.columns)] == docs.columns and (len(out.columns) == len(docs.columns)) == (name != "shard")
