"""Language of texts, with spans for mixed ones.

Words (runs of letters) are scored per language by hashed trigrams of characters, naive Bayes. The script of a word's letters
narrows the languages: only those that used the script in training may claim it. Viterbi over the words, with a penalty
for each change of language, labels spans; the language with the most letters is the text's.

Each distinct word of a batch is scored once, by one table look-up per character. A text keeps one language throughout
unless some stretch of words gains over half a penalty by another; only texts with such a stretch need Viterbi, which
then runs over all of them in step. This is exact, see `viterbi`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, span_hashes, table, utf8

UND = "und"
#: First code points of script ranges and the number of the script; 0 holds no letters.
SCRIPTS = np.array([(0x0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 7), (0x900, 8), (0xE00, 9), (0x10A0, 10), (0x1100, 11), (0x1200, 12), (0x1E00, 1), (0x1F00, 2), (0x2C00, 13), (0x2DE0, 3), (0x2E80, 14), (0x3040, 15), (0x3100, 14), (0xAC00, 11), (0xD7B0, 13), (0xFB50, 6), (0xFE00, 13), (0x20000, 14), (0x30000, 13)])
N_SCRIPTS = 16


@dataclass(frozen=True)
class LanguageId:
    """sample: labelled rows of each language that training uses at most (those of the smallest id hashes). max_langs: languages that
    are learned at most, those of most labelled rows, so that a dirty column can't make the model grow. buckets: of the trigram table.
    """

    sample: int = 1500
    max_langs: int = 256
    buckets: int = 1 << 16
    penalty: float = 12.0
    seed: int = 7


def _codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point at each lead byte of UTF-8 data, and where the lead bytes are."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = np.zeros((4, len(lead)), np.int64)
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    for k in range(4):
        b[k] = padded[lead + k]
    one, two, three = b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0
    tail = b & 0x3F
    cp = np.where(one, b[0], np.where(two, (b[0] & 0x1F) << 6 | tail[1], np.where(three, (b[0] & 0xF) << 12 | tail[1] << 6 | tail[2], (b[0] & 7) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3])))
    return cp, lead


def _character_table() -> np.ndarray:
    """2 for letters, 1 for marks, which belong to the words they are in, else 0, as Python's character data says."""
    import unicodedata

    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


_characters: list[np.ndarray] = []


@dataclass(frozen=True)
class Words:
    """Words of some rows: runs of letters and marks with one letter at least.

    row, letters (without marks), script (of the first letter or mark), first code point and number of them, per word; and
    the code points of all rows.
    """

    n_rows: int
    row: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    start: np.ndarray
    size: np.ndarray
    codes: np.ndarray

    def keys(self, which: np.ndarray, buckets: int) -> np.ndarray:
        """Features of some words, one after another: trigrams of code points over blank + word + blank, so as many as code points."""
        start, size = self.start[which], self.size[which]
        at = _ranges(start, size)
        if not len(at):
            return at
        ends = np.cumsum(size)
        before, after = self.codes[at - 1], self.codes[np.minimum(at + 1, len(self.codes) - 1)]
        before[ends - size] = 32
        after[ends - 1] = 32
        h = (before * 0x9E3779B1 + self.codes[at] * 0x85EBCA77 + after * 0xC2B2AE3D).astype(np.uint64)
        h = ((h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) >> np.uint64(12)
        return (h % np.uint64(buckets)).astype(np.int64)


def words_of(column: pa.Array) -> Iterator[Words]:
    """The words of row ranges. Null counts as empty."""
    if not _characters:
        _characters.append(_character_table())
    data, starts = utf8(pc.utf8_lower(column.fill_null("") if column.null_count else column))
    for i, j in slices(starts, 1 << 19):
        part, off = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        none = np.zeros(0, np.int64)
        if not len(part):
            yield Words(j - i, none, none, none, none, none, none)
            continue
        codes, lead = _codepoints(part)
        kind = _characters[0][codes]
        inside = kind > 0
        row = np.searchsorted(off, lead, side="right") - 1
        first, last = inside.copy(), inside.copy()
        edge = row[1:] != row[:-1]
        first[1:] &= ~inside[:-1] | edge
        last[:-1] &= ~inside[1:] | edge
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        letters = np.concatenate(([0], np.cumsum(kind == 2)))
        letters = letters[e] - letters[s]
        s, e, letters = s[letters > 0], e[letters > 0], letters[letters > 0]
        script = SCRIPTS[np.searchsorted(SCRIPTS[:, 0], codes[s], side="right") - 1, 1]
        yield Words(j - i, row[s], letters, script, s, e - s, codes)


# ---------------------------------------------------------------- training


@dataclass(frozen=True)
class Model:
    """langs; weights[bucket, lang]: log probability; scripts[script, lang]: whether training saw it."""

    langs: tuple[str, ...]
    weights: np.ndarray
    scripts: np.ndarray


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id, as text, leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, p: LanguageId = LanguageId(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram and script counts per language from at most p.sample rows of each that aren't held out.

    Rows that repeat an id with the same lang count as one. What reaches the driver are counts of (language, bucket): their number is bounded by the
    table and p.max_langs. Ties of languages with as many ids, about: the first in order.
    """
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit(p.seed)).alias("key"))
    # the sample's hashes first: whole texts don't take part in finding the smallest
    found = rows.groupBy("lang").agg(F.greatest(F.approx_count_distinct("key"), F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(p.max_langs).collect()
    if not found:
        return Model((), np.zeros((p.buckets, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    # twice as many as are needed and a hundred, on average, so that few rows have to be ranked
    limits = [(r.lang, (2**64 - 1) * min(2 * p.sample + 100, r.n) // r.n - 2**63) for r in found]
    spark = docs.sparkSession
    few = rows.join(F.broadcast(spark.createDataFrame(limits, "lang string, most long")), "lang").filter("key <= most").select("lang", "key").distinct()
    ranked = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).filter(F.col("place") <= p.sample)
    bounds = ranked.groupBy("lang").agg(F.max("key").alias("most")).collect()  # one row per language
    bounds = F.broadcast(spark.createDataFrame([(r.lang, r.most) for r in bounds], "lang string, most long"))
    sample = rows.join(bounds, "lang").filter("key <= most").dropDuplicates(["lang", "key"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            at = 0
            for w in words_of(batch.column(1)):
                own = langs[at : at + w.n_rows]
                for lang in set(own):
                    mine = np.flatnonzero(own[w.row] == lang)
                    grams, seen = totals.setdefault(lang, (np.zeros(p.buckets, np.int64), np.zeros(N_SCRIPTS, np.int64)))
                    grams += np.bincount(w.keys(mine, p.buckets), minlength=p.buckets)
                    seen += np.bincount(w.script[mine], minlength=N_SCRIPTS)
                at += w.n_rows
        for lang, both in totals.items():
            for kind, counts in enumerate(both):
                k = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array([kind] * len(k), pa.int32()), pa.array(k, pa.int64()), pa.array(counts[k], pa.int64())], names=["lang", "kind", "key", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, kind int, key long, n long")
    got = counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(got["lang"].unique()))
    grams, scripts = np.zeros((p.buckets, len(langs))), np.zeros((N_SCRIPTS, len(langs)))
    for x, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        for kind, out in ((0, grams), (1, scripts)):
            part = own[own["kind"] == kind]
            out[part["key"].to_numpy(), x] = part["n"].to_numpy()
    smooth = np.log(grams + 0.5) - np.log(grams.sum(axis=0) + 0.5 * p.buckets)
    # a text of another language inside a document of this one is no proof that the language uses its script
    return Model(langs, smooth.astype(np.float32), scripts > 0.01 * scripts.sum(axis=0))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each start as many as its size."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - np.concatenate(([0], ends[:-1])), sizes)


# ---------------------------------------------------------------- prediction


def word_scores(model: Model, w: Words) -> np.ndarray:
    """[word, lang]: sums of log probabilities over a word's trigrams, -inf-like where the script excludes a language.

    Each distinct word is scored once. A script that no language used excludes none, and its words say nothing.
    """
    _, which, place = np.unique(span_hashes(w.codes, w.start, w.start + w.size), return_index=True, return_inverse=True)
    size = w.size[which]
    out = np.add.reduceat(model.weights[w.keys(which, len(model.weights))].astype(np.float64), np.cumsum(size) - size, axis=0)
    # long words of one document shouldn't outweigh all else
    out -= out.max(axis=1, keepdims=True)
    may = model.scripts[w.script[which]]
    none = ~may.any(axis=1)
    out[~may] = -60.0
    out[none] = 0.0
    return np.maximum(out, -60.0)[place]


def viterbi(scores: np.ndarray, rows: np.ndarray, n_rows: int, penalty: float) -> np.ndarray:
    """The language of each word: the path of the greatest sum of scores less penalties, within each row.

    A constant path in the language a of the greatest total is the best if, for every other language, no run of
    words gains more than penalty/2 over a: a path of j runs outside of a pays for j changes at least if it
    touches a, and for j-1 >= j/2 if it doesn't and j > 1.
    """
    out = np.zeros(len(rows), np.int64)
    if not len(rows):
        return out
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    totals = np.add.reduceat(scores, bounds[full], axis=0)
    best = np.zeros(n_rows, np.int64)
    best[full] = totals.argmax(axis=1)
    out[:] = best[rows]
    gain = scores - scores[np.arange(len(rows)), out][:, None]
    mixed = []
    # gain of the best run: with sums c, the most of c[j] - min(c[i]) for i <= j, row by row
    sums = np.concatenate((np.zeros((1, scores.shape[1])), np.cumsum(gain, axis=0)))
    for r in full:
        c = sums[bounds[r] : bounds[r + 1] + 1]
        if (c - np.minimum.accumulate(c, axis=0)).max() > penalty / 2:
            mixed.append(r)
    if mixed:
        _step(scores, bounds, np.array(mixed), penalty, out)
    return out


def _step(scores: np.ndarray, bounds: np.ndarray, rows: np.ndarray, penalty: float, out: np.ndarray) -> None:
    """Viterbi of several rows, word by word in step, longest first, in groups of bounded size."""
    rows = rows[np.argsort(bounds[rows] - bounds[rows + 1], kind="stable")]
    n_langs = scores.shape[1]
    for g in range(0, len(rows), 64):
        group = rows[g : g + 64]
        first, size = bounds[group], bounds[group + 1] - bounds[group]
        back = np.zeros((size[0], len(group), n_langs), np.int8 if n_langs < 128 else np.int32)
        v = scores[first].copy()
        for t in range(1, size[0]):
            live = int(np.searchsorted(-size, -t, side="left"))  # rows longer than t
            now = v[:live]
            top = now.argmax(axis=1)
            change = now[np.arange(live), top] - penalty
            stay = now >= change[:, None]
            back[t, :live] = np.where(stay, np.arange(n_langs), top[:, None])
            v[:live] = np.where(stay, now, change[:, None]) + scores[first[:live] + t]
        for k in range(len(group)):
            lang = int(v[k].argmax())
            for t in range(size[k] - 1, -1, -1):
                out[first[k] + t] = lang
                lang = int(back[t, k, lang]) if t else lang


def predict(docs: DataFrame, model: Model, p: LanguageId = LanguageId(), id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id, held_out, lang_pred, score[, spans]) of every row.

    lang_pred is the language of most letters and score its share; ties go to the first in order. A null text or one
    without letters (digits, marks, emoji and private characters are none) is `und` with score 0, and so is every text if nothing
    was learned. spans: arrays of (lang, words) in text order. No shuffle; the model has a fixed size per language and
    LanguageId.max_langs of them at most.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = [*m.langs, UND]
        for batch in batches:
            pred, score, told = [], [], []
            for w in words_of(batch.column(2)):
                n, row = w.n_rows, w.row
                lang = np.full(n, len(m.langs), np.int64)
                share = np.zeros(n)
                path = np.zeros(0, np.int64)
                if m.langs and len(row):
                    path = viterbi(word_scores(m, w), row, n, p.penalty)
                    weight = np.bincount(row * len(m.langs) + path, weights=w.letters, minlength=n * len(m.langs)).reshape(n, -1)
                    total = weight.sum(axis=1)
                    has = total > 0
                    lang[has] = weight[has].argmax(axis=1)
                    share[has] = weight[has].max(axis=1) / total[has]
                pred += [names[x] for x in lang]
                score.append(share)
                if spans:
                    cuts = np.searchsorted(row, np.arange(n + 1)) if len(path) else np.zeros(n + 1, np.int64)
                    for r in range(n):
                        own = path[cuts[r] : cuts[r + 1]]
                        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
                        told.append([{"lang": names[own[a]], "words": int(b - a)} for a, b in zip(at, [*at[1:], len(own)][: len(at)], strict=True)])
            columns = [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())]
            if spans:
                columns.append(pa.array(told, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "lang_pred", "score", "spans"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double" + ", spans array<struct<lang:string,words:long>>" * spans)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, train(docs)).withColumnRenamed("id", "doc_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op10_language": op10_language}
