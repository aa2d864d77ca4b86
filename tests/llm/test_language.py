"""Language predictions: held-out accuracy, and Viterbi against all paths."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np

from corvane.llm.language import LanguageId, op10_language, predict, train, viterbi


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op10_language(spark, d).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.97 * len(out)


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    for penalty in (0.0, 0.5, 2.0, 6.0):
        sizes = rng.integers(0, 7, 30)
        rows = np.repeat(np.arange(30), sizes)
        scores = np.round(rng.normal(0, 2, (len(rows), 3)), 3)

        def total(own, path, penalty=penalty):
            return sum(own[t, x] for t, x in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))

        path = viterbi(scores, rows, 30, penalty)
        for r in range(30):
            own = scores[rows == r]
            if len(own):
                best = max(total(own, p) for p in itertools.product(range(3), repeat=len(own)))
                assert abs(total(own, path[rows == r]) - best) < 1e-9


def _corpus():
    rng = random.Random(1)
    words = {"en": "the and of that with this from have which were".split(), "fr": "le les des une dans être avec pour où été".split(), "ru": "и в не на что он это как она по".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(60)), x) for i, x in ((i, ["en", "fr", "ru"][i % 3]) for i in range(120))]
    return words, rows


def test_spans_scripts_and_edges(spark):
    words, rows = _corpus()
    docs = spark.createDataFrame(rows + [(500, None, "en"), (501, "the of", None), (None, "the", "en")], "doc_id long, text string, lang string")
    model = train(docs)
    assert model.langs == ("en", "fr", "ru")
    texts = [None, "", "12 34 !?", "日本語", " ".join(words["en"] * 3 + words["fr"] * 3), "и " * 5000, "THE AND OF THAT", "x"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, held_out string")
    got = {r.id: r for r in predict(df, model, spans=True).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[0].score == 0
    assert got[3].lang_pred in model.langs  # letters, but of a script that no language has
    assert [(s.lang, s.words) for s in got[4].spans] == [("en", 30), ("fr", 30)]
    assert got[5].lang_pred == "ru" and got[5].score == 1.0 and got[6].lang_pred == "en"
    assert predict(df.limit(0), model).collect() == []
    empty = train(docs.limit(0))
    assert {r.lang_pred for r in predict(df, empty).collect()} == {"und"}


def test_features_are_not_the_label_or_id(spark):
    _, rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, LanguageId(sample=50))
    moved = spark.createDataFrame([(i + 10_000, t, "xx") for i, t, _ in rows], docs.schema)
    a = {r.id: (r.lang_pred, r.score) for r in predict(docs, model).collect()}
    b = {r.id - 10_000: (r.lang_pred, r.score) for r in predict(moved, model).collect()}
    assert a == b


def test_only_letters_make_a_language(spark):
    words, rows = _corpus()
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    none = ["❤️ 123", "️", "́́", "", "\U000f0000", "\U0010fffd", "\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U000e0100", "①②", "٣٤", "‍"]
    some = ["́the and", "ĺe", "\U00030000", "ǅ", "ª the"]
    df = spark.createDataFrame(list(enumerate(none + some)), "doc_id long, text string")
    got = {r.id: (r.lang_pred, r.score) for r in predict(df, model).collect()}
    assert [got[i] for i in range(len(none))] == [("und", 0.0)] * len(none)
    assert all(got[i][0] in model.langs for i in range(len(none), len(none) + len(some)))


def test_prediction_is_that_of_a_plain_loop(spark):
    """Trigrams, scripts, scores and paths of a part of the table, word by word."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    p = LanguageId()
    model = train(docs, p)
    got = {r.id: r for r in predict(docs, model, p, spans=True).collect()}
    for r in docs.collect():
        found = [[x for x in w] for w in re.findall(r"(?:(?!\d|_)\w|[̀-ͯ])+", (r.text or "").lower()) if any(c.isalpha() for c in w)]
        if len(found) > 400:
            continue
        scores = []
        for w in found:
            total = np.zeros(len(model.langs))
            for a, b, c in zip([" ", *w[:-1]], w, [*w[1:], " "], strict=True):
                h = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) % 2**64
                h = ((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**64 >> 12
                total += model.weights[h % p.buckets]
            scores.append(np.maximum(total - total.max(), -60))
        if not found:
            assert got[r.doc_id].lang_pred == "und"
            continue
        path = viterbi(np.array(scores), np.zeros(len(found), np.int64), 1, p.penalty)
        letters = Counter()
        for w, x in zip(found, path, strict=True):
            letters[x] += sum(c.isalpha() for c in w)
        best = max(sorted(letters), key=letters.__getitem__)
        assert got[r.doc_id].lang_pred == model.langs[best] and abs(got[r.doc_id].score - letters[best] / sum(letters.values())) < 1e-9
        assert sum(s.words for s in got[r.doc_id].spans) == len(found)


def test_samples_are_by_language_and_bounded(spark):
    words, rows = _corpus()
    rows = [(i, t, x) for i, t, x in rows if x == "en" or i < 6] + [(5000 + i, "aa bb", f"dirty{i}") for i in range(60)] + [(7000, "the of and", "en")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, LanguageId(sample=3, max_langs=3))
    assert len(model.langs) == 3 and "en" in model.langs and model.weights.shape == (1 << 16, 3)
    every = train(docs, LanguageId(sample=3))
    assert {"en", "fr", "ru"} <= set(every.langs)
    got = predict(spark.createDataFrame([(1, " ".join(words["ru"] * 5)), (2, " ".join(words["fr"] * 5))], "doc_id long, text string"), every).collect()
    assert {r.id: r.lang_pred for r in got} == {1: "ru", 2: "fr"}
