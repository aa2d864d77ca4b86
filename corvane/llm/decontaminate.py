"""Benchmark decontamination: n-gram seeds find candidate passages, local alignment scores them.

1. Every n-gram of a benchmark item is a seed, in a row and with a word between left out, however many documents have it: an
   edited copy may keep just the grams that others keep too, in one document as in a third of all. Documents are cut into grams in the same two
   ways, so words that were replaced, dropped or added one at a time leave seeds.
2. A document that has a seed is a candidate for the seed's item. Candidates with too few of the item's words to reach the
   score are passed over; that bound is exact, so frequent grams cost a look-up and no result.
3. Smith-Waterman over words aligns the item with the passages around the seeds, so replaced, dropped and added words cost
   little; documents whose best score reaches a share of the perfect score are contaminated.

A copy that keeps no n words of the item with at most one other word between them has no seed, though it may still reach the score (README
has figures). Items of fewer than n + 1 words are only found where they stand unchanged. One scan of the texts for a block of items,
without a shuffle. Seeds are sent to the workers in blocks of bounded size: a benchmark of any size is handled block by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import BYTES, constants, lean, mix, slices, span_hashes, table, utf8, word_spans

#: Bytes that separate words: all of ASCII but letters and digits. Other punctuation is blanked beforehand.
SEPARATORS = np.array([not (48 <= b < 58 or 97 <= b < 123 or b >= 128) for b in range(256)])
OTHER_PUNCTUATION = r"[\x{80}-\x{BF}\x{D7}\x{F7}\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FE30}-\x{FE4F}\x{FF01}-\x{FF0F}\x{FEFF}]"

#: Pairs of a seed and an item that are held at once, on average of the rows.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Decontamination:
    """n: words of a seed. score: least share of the perfect score (match 2, mismatch and gap -1).

    block_items, block_bytes: benchmark items, and bytes of their texts, whose seeds are sent at once, on average of the
    blocks; items of any length count whole.
    """

    n: int = 4
    score: float = 0.5
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    block_items: int = 20_000
    block_bytes: int = 16 << 20


# ---------------------------------------------------------------- words


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For row ranges: number of rows, word hashes and their rows. Words are lower-cased runs of letters and digits."""
    if column.null_count:
        column = column.fill_null("")
    low = pc.replace_substring_regex(pc.utf8_lower(column), OTHER_PUNCTUATION, " ")
    data, starts = utf8(low)
    for i, j in slices(starts, BYTES):
        part, off = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        s, e, rows = word_spans(part, off, SEPARATORS)
        yield j - i, span_hashes(part, s, e), rows


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: words of each, and all n-grams, sorted, with the items that have them.

    grams[k] belongs to the items owners[first[k]:first[k+1]]. Items of fewer than n words have one shorter gram, found
    by its own length. maybe: by the top bits of a hash, whether some gram has them.
    """

    ids: np.ndarray
    words: list[np.ndarray]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _shapes(n: int) -> list[tuple[int, ...]]:
    """Places of the words of a gram: in a row, and with one word left out at each place between. Short grams only in a row."""
    row = tuple(range(n))
    return [row] + [tuple(k + (k >= gap) for k in row) for gap in range(1, n) if n >= 4]


def _grams(words: np.ndarray, rows: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """ngram_hashes() for words at some places: the same words in the same order have the same hash, whatever the shape."""
    n, span = len(shape), shape[-1] + 1
    if len(words) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c, m = constants(n, 17 * n), len(words) - span + 1
    h = np.zeros(m, np.uint64)
    for k, place in enumerate(shape):
        h += words[place : place + m] * c[k]
    at = np.flatnonzero(rows[:m] == rows[span - 1 :])
    return mix(h[at] + np.uint64(n)), at


def items_block(rows: list[Row], p: Decontamination) -> Items:
    """Items without words have no grams; equal items each have their own."""
    ids = np.array([r.item_id for r in rows], np.int64)
    words: list[np.ndarray] = []
    for n, hashes, owner in _words(pa.array([r.text for r in rows], pa.string())):
        cuts = np.searchsorted(owner, np.arange(n + 1))
        words += [hashes[cuts[k] : cuts[k + 1]] for k in range(n)]
    found: dict[int, list[tuple[int, int]]] = {}
    for k, w in enumerate(words):
        length = min(p.n, len(w))
        if length:
            grams = np.concatenate([_grams(w, np.zeros(len(w), np.int64), shape)[0] for shape in _shapes(length)])
            found.setdefault(length, []).extend((int(g), k) for g in np.unique(grams))
    by_length = {}
    for length, pairs in found.items():
        if pairs:
            grams = np.array([g for g, _ in pairs], np.uint64)
            owners = np.array([k for _, k in pairs], np.int64)
            order = np.lexsort((owners, grams))
            grams, owners = grams[order], owners[order]
            unique, first = np.unique(grams, return_index=True)
            bits = min(26, max(10, (16 * len(unique)).bit_length()))
            maybe = np.zeros(1 << bits, bool)
            maybe[unique >> np.uint64(64 - bits)] = True
            by_length[length] = (unique, np.append(first, len(grams)), owners, maybe)
    return Items(ids, words, by_length)


def _hits(words: np.ndarray, rows: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """Per gram length: row, place of the first word and gram index of each hit; length; first and owners of the block."""
    for length, (grams, first, owners, maybe) in items.by_length.items():
        shift = np.uint64(65 - len(maybe).bit_length())
        for shape in _shapes(length):
            hashes, at = _grams(words, rows, shape)
            some = np.flatnonzero(maybe[hashes >> shift])
            hashes, at = hashes[some], at[some]
            k = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
            hit = np.flatnonzero(grams[k] == hashes)
            if len(hit):
                yield rows[at[hit]], at[hit], k[hit], length, first, owners


# ---------------------------------------------------------------- passes


def align(item: np.ndarray, passage: np.ndarray, p: Decontamination) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the passage word at which it ends (exclusive)."""
    best, end = 0, 0
    steps = np.arange(len(passage) + 1, dtype=np.int64) * -p.gap
    above = np.zeros(len(passage) + 1, np.int64)
    for w in item:
        row = np.zeros(len(passage) + 1, np.int64)
        row[1:] = above[:-1] + np.where(passage == w, p.match, p.mismatch)
        np.maximum(row, above + p.gap, out=row)
        np.maximum(row, 0, out=row)
        # a gap in the item: the best earlier cell less its distance
        row = np.maximum.accumulate(row + steps) - steps
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        above = row
    return best, end


def _document(words: np.ndarray, offset: int, places: np.ndarray, item: np.ndarray, p: Decontamination) -> tuple[int, int]:
    """Best score of an item over the passages around its seeds in one document, and the word at which it ends."""
    reach = 2 * len(item) + p.n
    best, end = 0, 0
    need = p.score * p.match * len(item)
    places = np.sort(places)
    groups = np.split(places, np.flatnonzero(np.diff(places) > reach) + 1)
    for g in groups:
        lo, hi = max(0, int(g[0]) - reach), min(len(words), int(g[-1]) + reach)
        for a in range(lo, hi, 8 * reach):  # a passage that repeats the item over and over is aligned piece by piece
            piece = words[a : min(hi, a + 9 * reach)]
            if p.match * np.count_nonzero(np.isin(item, piece)) < need:
                continue
            score, at = align(item, piece, p)
            if score > best:
                best, end = score, offset + a + at
    return best, end


def _pairs(words: np.ndarray, rows: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, item and word of every seed with every item that has it, sorted, for whole rows at a time."""
    hits = [(row, at, first[gram], first[gram + 1] - first[gram], owners) for row, at, gram, _, first, owners in _hits(words, rows, items)]
    if not hits:
        return
    per_row = np.zeros(int(rows[-1]) + 1, np.int64)
    for row, _, _, n, _ in hits:
        np.add.at(per_row, row, n)
    part = np.cumsum(per_row) // PAIRS  # the last rows of two parts bound what is held at once
    for k in np.unique(part[per_row > 0]):
        out = []
        for row, at, start, n, owners in hits:
            chosen = np.flatnonzero(part[row] == k)
            times = n[chosen]
            inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            out.append((np.repeat(row[chosen], times), owners[np.repeat(start[chosen], times) + inner], np.repeat(at[chosen], times)))
        r, i, w = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((w, i, r))
        yield r[order], i[order], w[order]


def _matches(words: np.ndarray, rows: np.ndarray, n_rows: int, items: Items, p: Decontamination) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, score, words of the item, end word) of the contaminated pairs."""
    cuts = np.searchsorted(rows, np.arange(n_rows + 1))
    for row, item, word in _pairs(words, rows, items):
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
        last = np.append(first[1:], len(row))
        for r in np.unique(row):
            a, b = np.searchsorted(row[first], [r, r + 1])
            of = item[first[a:b]]
            document = words[cuts[r] : cuts[r + 1]]
            # words of each item that the document has at all: no alignment scores more
            sizes = np.array([len(items.words[k]) for k in of])
            present = np.add.reduceat(np.isin(np.concatenate([items.words[k] for k in of]), document).astype(np.int64), np.cumsum(sizes) - sizes)
            for c in np.flatnonzero(p.match * present >= p.score * p.match * sizes):
                k, size = int(of[c]), int(sizes[c])
                score, end = _document(document, 0, word[first[a + c] : last[a + c]] - cuts[r], items.words[k], p)
                if score >= p.score * p.match * size:
                    yield int(r), k, score, size, end


def _blocks(benchmark: DataFrame, p: Decontamination) -> Iterator[Items]:
    """Benchmark items with their seeds, block by block. Null items and such without words have none."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(-(-size.n // p.block_items), -(-size.bytes // p.block_bytes))
    for part in range(parts):
        yield items_block(rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "text").collect(), p)


def leaks(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, score, share, end_word): one row for each document and item that it contains, score as aligned.

    Null and empty texts contain nothing. Rows that repeat an id each give their own rows.
    """
    spark = docs.sparkSession
    schema = "id long, item_id long, score long, share double, end_word long"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, p):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                ids, found, at = batch.column(0), [], 0
                for n, words, rows in _words(batch.column(1)):
                    found += [(at + r, int(items.ids[k]), s, s / (p.match * size), end) for r, k, s, size, end in _matches(words, rows, n, items, p)]
                    at += n
                columns = [ids.take(pa.array([x[0] for x in found], pa.int64()))]
                columns += [pa.array([x[c] for x in found], kind) for c, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "item_id", "score", "share", "end_word"])

        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        out = out.unionByName(rows.mapInArrow(lean(run), schema))
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination(), text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that contain no benchmark item."""
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, p):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                clean, done = np.ones(batch.num_rows, bool), 0
                column = batch.column(at)
                for n, words, rows in _words(column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())):
                    for r, *_ in _matches(words, rows, n, items, p):
                        clean[done + r] = False
                    done += n
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, with the score."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op1_decontaminate": op1_decontaminate}
