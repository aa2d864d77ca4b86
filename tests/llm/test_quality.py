"""Quality counts against plain Python, and the guarantee of the cutoffs."""

import math
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm.quality import GRID, RULES, Quality, _tail, cutoffs, judge, op4_quality, passing, with_features

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {x for x in windows if windows.count(x) > 1} if len(windows) < 400 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in often for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in op4_quality(spark, d).collect():
        c = counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 10 or 100 * c[4] > 20 * c[0])
        assert not (r.base_failed and r.kept)


def test_edges(spark):
    texts = [None, "", " \n\t", "a", "a b c d e f a b c d e", "x " * 3000, "l1\nl1\n \n \nl1 \n", "a|b<c>#*$%&", "é b\x85c d", "\x1ca b", "a b c d e\na b c d e\na b c d e"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("text_words", F.lit(1)).withColumn("whole_text", F.lit(2))
    got = {r.doc_id: tuple(r.quality)[:5] for r in with_features(df).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}
    assert with_features(df.limit(0)).collect() == []


@pytest.mark.parametrize("n, k, risk", [(100, 0, 0.02), (1000, 3, 0.02), (20000, 60, 0.005), (5, 5, 0.5), (4000, 0, 0.3)])
def test_binomial_tail(spark, n, k, risk):
    exact = 1.0 if k >= n * risk else sum(math.comb(n, i) * (risk**i) * ((1 - risk) ** (n - i)) for i in range(k + 1)) if n < 5000 else math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk)) for i in range(k + 1))
    got = spark.range(1).select(_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), risk).alias("x")).first().x
    assert got == pytest.approx(exact, rel=1e-6, abs=1e-300)


def test_cutoffs_keep_good_documents_and_cut_bad_ones(spark):
    good = " ".join(f"w{i}" for i in range(40))
    noisy = " ".join(f"w{i}##" for i in range(40))
    rows = [(i, "en", good if i % 10 else noisy) for i in range(4000)] + [(i, None, noisy) for i in range(4000, 4020)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1 if i % 10 else 0) for i in range(4000)] + [(0, 0), (None, 1)] + [(i, 0) for i in range(4000, 4020)], "doc_id long, quality int")
    chosen = cutoffs(docs, labels)
    table = {(r.stratum, r.rule): r for r in chosen.collect()}
    assert set(table) == {("en", "symbols")}  # 20 labels prove nothing for the null stratum
    assert table["en", "symbols"].n_good_rejected == 0 and table["en", "symbols"].n_bad_rejected == 400
    kept = {r.doc_id: r.quality.kept for r in judge(docs, chosen).collect()}
    assert all(kept[i] == bool(i % 10) for i in range(4000)) and all(kept[i] for i in range(4000, 4020))
    joined = {r.doc_id: r.quality.kept for r in judge(docs, chosen, Quality(max_strata=0)).collect()}
    assert joined == kept
    assert cutoffs(docs, labels.limit(0)).collect() == [] and len(RULES) == 4


def rule_values(text):
    n = max(1, counts(text)[0])
    c = counts(text)
    return {"symbols": 1000 * c[2] // n, "repeats": 1000 * c[4] // n, "lines": 10000 * c[3] // n, "bangs": 1000 * (text or "").count("!") // n}


def base(text):
    c = counts(text)
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


def chosen_by_loops(docs, labels, risk, error):
    """{(stratum, rule): cutoff}: sets of cutoffs one after another, each with its binomial tail in exact sums."""
    good = {}
    for i, q in labels:
        if i is not None and q in (0, 1):
            good[i] = min(q, good.get(i, 1))
    rows = [(lang, rule_values(text), good[i]) for i, lang, text in docs if i in good and not base(text)]
    out = {}
    for stratum in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == stratum]
        level = error * len(own) / len(rows)
        n = sum(q for _, _, q in own)
        limits, safe = {}, {}
        for c in reversed(GRID):
            stop = False
            for rule in RULES:
                limits[rule] = c
                k = sum(q for _, v, q in own if any(v[x] > y for x, y in limits.items()))
                tail = 1.0 if k >= n * risk else sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
                if tail > level:
                    stop = True
                    break
                safe.setdefault(rule, []).append(c)
            if stop:
                break
        for rule, cs in safe.items():
            gain = [(sum(1 - q for _, v, q in own if v[rule] > c) - sum(q for _, v, q in own if v[rule] > c), c) for c in cs]
            best = max(gain)
            if best[0] > 0:
                out[stratum, rule] = best[1]
    return out


@pytest.mark.parametrize("sf, risk, error", [("0.01", 0.02, 0.05), ("0.01", 0.1, 0.2), ("0.1", 0.02, 0.05)])
def test_verdicts_are_those_of_plain_loops(spark, sf, risk, error):
    d = f"/root/testdata/sf{sf}"
    table = spark.read.parquet(f"{d}/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    docs = [(r.doc_id, r.lang, r.text) for r in table.collect()]
    want = chosen_by_loops(docs, labels, risk, error)
    p = Quality(risk=risk, error=error)
    got = {(r.stratum, r.rule): r.cutoff for r in cutoffs(table, spark.read.parquet(f"{d}/labels.parquet"), p).collect()}
    assert got == want
    if risk == 0.02:
        assert want  # the method decides something at this size
        values = {i: (lang, text) for i, lang, text in docs}
        kept = {r.doc_id: r.kept for r in op4_quality(spark, d).collect()}
        for i, (lang, text) in values.items():
            v = rule_values(text)
            assert kept[i] == (not base(text) and not any(v[rule] > c for (s, rule), c in want.items() if s == lang)), i


def test_passing_keeps_rows_and_columns(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(1, good, "q", "en"), (1, good, "q", "en"), (2, None, "q", None), (3, "", "q", "en"), (None, good, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = passing(docs, labels)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[1], rows[4]], key=str)
    assert passing(docs.limit(0), labels).collect() == [] and passing(docs, labels.limit(0)).count() == 3
