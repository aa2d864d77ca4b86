"""Near-duplicate components against a brute-force comparison of all pairs."""

import random

import pytest

from corvane.llm import components
from corvane.llm.near_dup import NearDup, near_duplicates, op6_near_dup, without_copies

GAPS = "\t\n\x0b\x0c\r "


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for g in GAPS:
        low = low.replace(g, " ")
    return [w for w in low.split(" ") if w]


def brute(rows, k=3, percent=85):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = sorted((find(ids[a]), find(ids[b])))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df):
    return {r.id if "id" in r else r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = op6_near_dup(spark, sf_dir)
    assert out.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(out) == brute(rows)


@pytest.mark.parametrize("blocks", [(1024, 1_000_000), (8, 700)])
def test_chains_copies_and_small_blocks(spark, blocks):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(40, 90))]
        for _ in range(rng.randint(1, 25)):  # each copy is edited further: chains of links
            rows.append((i, (" " if i % 3 else " \n").join(text)))
            i += 1
            if rng.random() < 0.7:
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = NearDup(block_rows=blocks[0], block_shingles=blocks[1])
    assert found(near_duplicates(df, p)) == brute(rows)


def test_nulls_blanks_short_and_clashing_columns(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \t\n", 3), (4, "Ab", 4), (5, "aB ", 5), (6, "ab cd", 6), (7, "AB\tCD", 7), (8, "É a b", 8), (9, "é a b", 9), (None, "ab cd", 0), (10, "x " * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumn("grp", df_lit()).withColumn("id", df_lit())
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    want = [(1, 0, 1, True), (10, 1, 10, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True), (9, 1, 9, True), (None, 1, None, True)]
    assert got == sorted(want, key=str)


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []


@pytest.mark.parametrize("least", [100, 1])
def test_chains_whose_ends_are_unlike(spark, monkeypatch, least):
    """Second rounds by band, tiny blocks, and nodes with more than one row counted as heavy."""
    monkeypatch.setattr(components, "LEAST", least)
    monkeypatch.setattr(components, "SHARES", 1000 if least > 1 else 20)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    text, rows = [rng.choice(vocabulary) for _ in range(60)], []
    for i in range(120):  # links between neighbours, none between the ends
        rows.append((i, " ".join(text)))
        text = [*text[2:], rng.choice(vocabulary), rng.choice(vocabulary)]
    rows += [(1000 + i, t) for i, t in rows[::7]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = NearDup(block_rows=8, block_shingles=700, late_rows=16)
    assert found(near_duplicates(df, p)) == brute(rows)


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(components, "LEAST", 3)
    monkeypatch.setattr(components, "SHARES", 10)
    rng = random.Random(2)
    edges = [(7, i) for i in range(100, 400)] + [(399, i) for i in range(400, 700)] + [(1, 699), (2, 3), (3, 2), (4, 4), (None, 5)] + [(i, i + 1) for i in range(1000, 1040)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys([1, 7, *range(100, 700)], 1) | {2: 2, 3: 2} | dict.fromkeys(range(1000, 1041), 1000)
    assert got == want


def test_rows_that_share_an_id(spark):
    a, b, c = ("the quick brown fox jumps over the lazy dog and runs away " + x for x in ("now", "up in the hills with a bear", "down by the river side"))
    d = " ".join(f"other{i}" for i in range(30))
    rows = [(1, a, "x"), (5, a, "copy"), (5, d, "own"), (5, d, "again"), (6, d, "copy"), (7, None, "null"), (7, "", "empty"), (None, a, "no id"), (2, b, "b"), (2, c, "c"), (3, c, "copy of c"), (1, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone string").withColumn("gone_id", df_lit()).withColumn("Gone_Text", df_lit())
    kept = without_copies(df, NearDup(shingle=5, percent=80))
    assert kept.columns == df.columns
    assert sorted(r["__gone"] for r in kept.collect()) == sorted(["x", "x", "own", "again", "null", "empty", "no id", "b", "c"])
    got = {(r.id, r.n_shingles): r.component_id for r in near_duplicates(df).collect()}
    assert got[5, 28] == 5 and got[6, 28] == 5 and got[5, 11] == 1


def test_recall_of_links_at_the_threshold(spark):
    """Pairs from 0.85 to 0.9 only, each a component of its own: not one is lost."""
    rng = random.Random(9)
    rows, want = [], 0
    for i in range(600):
        text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        edited = list(text)
        for k in range(2):
            edited[30 + 60 * k] = "edit"
        if i % 2:
            edited = edited[:-6]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(edited))]
        sets = [{tuple(t[j : j + 3]) for j in range(len(t) - 2)} for t in (text, edited)]
        want += 100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1])
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert want >= 600 * 0.9 and got.filter("not kept").count() == want
