"""Column functions against Python's own, over a wide range of characters."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.dataset import _SUFFIX, leakage_check


def test_parity(spark):
    rng = random.Random(4)
    odd = [chr(c) for c in [*range(0x1, 0x21), 0x7F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF]]
    texts = ["", " ", "a", "\r\n", "a\r\nb\x0b\x0cc"] + ["".join(rng.choice(odd + list("ab")) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + [f"{chr(c)}x{chr(c)}y{chr(c)}" for c in range(1, 0x3100)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r for r in df.select("i", X.word_count(F.col("t")).alias("w"), X.line_count(F.col("t")).alias("n"), X.content_hash(F.col("t")).alias("h")).collect()}
    for i, t in enumerate(texts):
        assert got[i].w == len(t.split()), repr(t)
        assert got[i].n == sum(1 for x in t.splitlines() if x.strip()), repr(t)
        assert got[i].h == hashlib.sha256(t.strip().encode()).hexdigest(), repr(t)


def test_leaks(spark):
    cases = [
        ("nothing here", []), ("see .PY files", [r"\.py\b"]), ("a.py\u00e9", []), ("GitHub.comx", [r"github\.com"]), ("x .ts", [r"\.ts\b"]), ("in repo12", [r"\brepo\d+\b"]), ("repo12a xrepo1 repo_1", []),
        ("def f( import os class A: src/x #L4", []), ("in core", ["symbol"]), ("CORE", []), ("my_test.py", [r"\.py\b", r"\w+_test\.py\b"]), ("test_a.py", [r"\.py\b", r"\btest_\w+\.py\b"]), ("BITBUCKET.org gitlab.com", [r"gitlab\.com", r"bitbucket\.org"]),
    ]
    df = spark.createDataFrame(cases, "q string, want array<string>")
    for r in df.select("q", "want", X.leak_violations(F.col("q"), F.lit(""), F.lit(None).cast("string"), F.lit("core")).alias("v")).collect():
        assert r.v == r.want, r.q


def test_rounding_is_that_of_python(spark):
    rng = random.Random(1)
    numbers = [2.675, 2.665, 0.5, 1.5, 2.5, -2.675, 1.005, 0.125, 1e-9, 5e-5, 2.5e-5, 5e-7, 123456789.125, 4.4e15, 1e300, -0.0, 1e12 + 0.5]
    numbers += [rng.choice([rng.random() * 10 ** rng.randint(-3, 9), rng.randint(0, 10**6) / 1000 + 0.0005, rng.randint(0, 10**5) / 200, rng.randint(1, 2000) / 2e6]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in numbers] + [(None,), (float("inf"),)], "x double")
    for digits in range(7):
        for r in df.select("x", X.py_round(F.col("x"), digits).alias("y")).collect():
            assert r.y == (r.x if r.x is None or abs(r.x) == float("inf") else round(r.x, digits)), (r.x, digits)


def test_small_ones(spark):
    one = spark.range(1)
    row = one.select(X.unit_id(F.lit("r"), F.lit("a\\b/c.py"), F.lit("C.f"), F.lit("0123456789abcdef")).alias("id"), X.source_url(F.lit(""), F.lit("p"), F.lit(1)).alias("none"), X.source_url(F.lit("u//"), F.lit("p"), F.lit(1)).alias("url"), X.size_gb(F.lit(4_700_000_000)).alias("gb"), X.ns_to_ms(F.lit(1_550_000)).alias("ms"), X.percent_change(F.lit(0.0), F.lit(1.0)).alias("p"), X.symbol_path(F.lit(None).cast("string"), F.lit("f")).alias("s")).first()
    assert row.id == "r_py_a_b_c_py__C_f_0123456789ab" and row.none == "" and row.url == "u/blob/main/p#L1" and row.gb == 4.38 and row.ms in (1.5, 1.6) and row.p is None and row.s == "f"


def test_leaks_anywhere_in_a_document(spark, tmp_path):
    suffix = _SUFFIX
    leaks = ["no leak", "see a.py", "Main.java", "b.ts", "https://github.com/x", "on gitlab.com", "#L7", "repo7", "def f (x)", "\u00c9t\u00e9_test.py", "test_\u00e9.py", "src0", "core", "Repo\u0663"]
    rows = [(11 * i + k, "src0", f"{'one two three ' * 5}{leak}{' and more' * 30}") for i, leak in enumerate(leaks) for k in (0, i % 11)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, source, text in rows:
        query = text + suffix[i % 11]
        found = [p for p in X.LEAKS if re.search(p, query, re.I)]
        found += [k for k, name in (("repository", source), ("symbol", "core")) if name in query]
        want.append((i, ",".join(found), not found))
    assert sorted(map(tuple, leakage_check(spark, str(tmp_path)).collect())) == sorted(want)
