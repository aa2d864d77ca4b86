"""Contaminated documents against a brute-force alignment of every document with every item."""

import random
import re

import numpy as np
import pytest

from corvane.llm.decontaminate import Decontamination, align, leaks, op1_decontaminate, remove_contaminated

WORD = re.compile(r"[^\W_]+")


def words(text):
    return WORD.findall((text or "").lower())


def smith_waterman(a, b, match=2, mismatch=-1, gap=-1):
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (match if x == y else mismatch), above[j + 1] + gap, row[j] + gap))
        best, above = max(best, *row), row
    return best


def test_align_is_smith_waterman():
    rng = random.Random(2)
    for _ in range(60):
        a, b = [rng.randrange(6) for _ in range(rng.randint(1, 12))], [rng.randrange(6) for _ in range(rng.randint(0, 25))]
        got = align(np.array(a, np.uint64), np.array(b, np.uint64), Decontamination())
        assert got[0] == smith_waterman(a, b)


def test_documents_against_all_pairs(spark, sf_dir):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {}
    for d, a in docs.items():
        have = set(a)
        for i, b in items.items():
            if sum(w in have for w in b) >= 0.5 * len(b) and (s := smith_waterman(b, a)) >= len(b):
                want[d, i] = s
    got = {(r.doc_id, r.item_id): r.score for r in op1_decontaminate(spark, sf_dir).collect()}
    assert want and got == want


@pytest.mark.parametrize("block", [20_000, 3])
def test_edited_copies_hot_items_and_edges(spark, block):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(8)] + [(8, "Tiny item"), (9, None), (10, ""), (11, "..."), (None, "x y z"), (12, "one")]
    rows, dirty = [], {}
    for i in range(300):
        body = [rng.choice(vocabulary) for _ in range(120)]
        if i % 3 == 0:  # item 0 leaks into a third of all documents
            k = 0 if i % 2 else i % 8
            copy = items[k][1].split()
            for _ in range(6):
                copy[rng.randrange(len(copy))] = "edited"
            del copy[rng.randrange(len(copy))]
            body[60:60] = [("**" + w.upper() + ",") for w in copy]
            dirty[i] = k
        rows.append((i, " ".join(body), "clash"))
    rows += [(400, None, ""), (401, "", ""), (402, "tiny ITEM!", ""), (403, "a tiny other item", ""), (404, "x y z " * 3000, ""), (None, items[1][1], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    p = Decontamination(block_items=block)
    got = {(r.id, r.item_id) for r in leaks(docs, benchmark, p).collect()}
    assert got == {*dirty.items(), (402, 8), (None, 1)}
    clean = remove_contaminated(docs, benchmark, p)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {*dirty, 402, None}
    assert leaks(docs.limit(0), benchmark, p).collect() == [] and leaks(docs, benchmark.limit(0), p).collect() == []


@pytest.mark.parametrize("times", [3, 50, 100])
def test_one_edited_copy_in_many_documents(spark, times):
    rng = random.Random(times)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(4)]
    copies = [" ".join(f"edited{k}" if k % 6 == 5 else w for k, w in enumerate(t.split())) for _, t in items]
    # item 3: an edited copy in one document, and another one that keeps other grams in many
    other = " ".join(w if k % 6 == 5 or k < 20 else f"other{k}" if k % 6 == 1 else w for k, w in enumerate(items[3][1].split()))
    rows = []
    for i in range(300):
        body = [rng.choice(vocabulary) for _ in range(100)]
        if i < times:
            body[30:30] = (other if i % 2 else copies[0]).split()
        elif i == 299:
            body[30:30] = copies[3].split()
        rows.append((i, " ".join(body)))
    want = {}
    for d, text in rows:
        for i, item in items:
            if (s := smith_waterman(words(item), words(text))) >= 40:
                want[d, i] = s
    got = leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) == times + 1 and {(r.id, r.item_id): r.score for r in got.collect()} == want


def edits(rng, w, kind, step):
    out = []
    for k, x in enumerate(w):
        hit = k % step == step - 1 if kind != "random" else rng.random() < step / 100
        if not hit:
            out.append(x)
        elif kind == "added":
            out += [x, f"more{k}"]
        elif kind in ("replaced", "random"):
            out.append(f"other{k}")
    return out


EDITS = [("replaced", 3), ("replaced", 4), ("replaced", 5), ("dropped", 3), ("dropped", 4), ("added", 2), ("added", 3), ("random", 10), ("random", 20), ("random", 30)]


def test_recall_of_edited_copies(spark):
    """Spread edits of each kind: whatever the alignment accepts over the whole text is found."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(40)]
    rows, wanted = [], {}
    for kind, step in EDITS:
        for i, text in items:
            d = len(rows)
            body = [rng.choice(vocabulary) for _ in range(60)]
            body[30:30] = edits(rng, text.split(), kind, step)
            rows.append((d, " ".join(body)))
            if smith_waterman(words(text), body) >= 40:
                wanted[d, i] = kind, step
    got = {(r.id, r.item_id) for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    lost = {}
    for key, kind in wanted.items():
        lost[kind] = lost.get(kind, 0) + (key not in got)
    assert len(wanted) > 330 and {k for _, k in got - wanted.keys()} == set()
    assert sum(lost.values()) == 0, lost
