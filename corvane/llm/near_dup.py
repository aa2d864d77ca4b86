"""Near-duplicate groups: MinHash bands propose, odd sketches sift, full shingle sets confirm.

1. One pass over the texts gives each document its set size, a 128-bit fingerprint of the set, band keys and
   an odd sketch. The sketch folds the MinHash samples into a bitmap by parity: a sample that two documents
   share cancels out in the XOR of their bitmaps, so the population count of the XOR measures how many differ.
2. Documents of equal sets collapse into a class with a number of its own; one document of the class, that of the
   smallest id, stands for it.
3. Classes that share a band key are compared by sketch (`link_within`). Only a spanning forest of
   the links found leaves a task, never all pairs of a group.
4. The candidate groups so found are compared once more, now on full sets, and what that confirms makes up
   the components.

`link_within` deals a group out in blocks of bounded weight. The group's leader goes to each block, so a large
group of alike documents comes together after one round. Only documents that didn't join their group's
main part go on: they meet all blocks of the group or, where those are many, those documents of the group that share a band key
with them. A long chain of documents, each like the next, so costs as much as its bands hold. What stays quadratic is a
crowd whose members all share bands, all look alike to the sketch and are yet not linked to the leader. No cap drops anything.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, BYTES, LOWER, constants, cut, free_name, lean, mix, ngram_hashes, slices, span_hashes, table, utf8, word_spans
from .components import attach, connected_components

SKETCH_BITS = 512


@dataclass(frozen=True)
class NearDup:
    """Similarity |A and B| / |A or B| of word-shingle sets of at least percent/100 links two documents.

    bands x rows MinHash samples: with 40 x 6, a pair at 0.85 shares no band with a chance of 6e-9, one at 0.8
    of 5e-6. `sigmas` standard errors of the sketch's estimate below the threshold, a pair is still confirmed
    on full sets.
    """

    shingle: int = 3
    percent: int = 85
    bands: int = 40
    rows: int = 6
    sigmas: float = 5.0
    block_rows: int = 1024
    block_shingles: int = 1_000_000
    late_rows: int = 16_384  # of a block in the second round of sketches, where each block meets all others

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_different_bits(self) -> int:
        """The largest XOR population count that may still belong to a linked pair.

        Of k samples, 2k(1-J) fall on differing values; they hit M bits at random, so the count z of odd bits
        has the mean M/2 (1 - exp(-2d/M)).
        """
        j, k, m = self.percent / 100, self.samples, SKETCH_BITS
        low = max(0.0, j - self.sigmas * (math.sqrt(j * (1 - j) / k) + 0.004))
        return int(math.ceil(m / 2 * (1 - math.exp(-2 * (2 * k * (1 - low)) / m))))


# ---------------------------------------------------------------- signatures


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    data, starts = utf8(column)
    for i, j in slices(starts, BYTES):
        off = starts[i : j + 1] - starts[i]
        part = LOWER[data[starts[i] : starts[j]]]
        s, e, rows = word_spans(part, off, BLANKS)
        words = span_hashes(part, s, e)
        hashes, at = ngram_hashes(words, rows, shingle)
        bounds = np.searchsorted(rows[at], np.arange(j - i + 1))
        per_row = np.searchsorted(rows, np.arange(j - i + 1))
        for r in range(j - i):
            if per_row[r + 1] - per_row[r] >= shingle:
                yield np.unique(hashes[bounds[r] : bounds[r + 1]])
            elif per_row[r + 1] > per_row[r]:
                w = words[per_row[r] : per_row[r + 1]]
                yield mix(np.array([np.sum(w * constants(len(w), 99 + len(w)))], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _samples(u: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash samples of one set under len(a) hash functions."""
    x = (u >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (a[:, None] * x[None, i : i + 2048] + b[:, None]).min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, p: NearDup, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n, fp1, fp2, bands, sketch) for every row; text_key is a hash of the text."""
    k = p.samples

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = (constants(k, 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        b = (constants(k, 2) >> np.uint64(32)).astype(np.uint32)
        lanes = np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        weights, salt = constants(p.rows, 3), np.arange(p.bands, dtype=np.uint64)
        for batch in batches:  # samples, bands and sketches take some ten kilobytes a row
            n, f1, f2 = [], [], []
            least = np.zeros((batch.num_rows, k), np.uint32)
            for r, u in enumerate(_sets(batch.column(2), p.shingle)):
                n.append(len(u))
                f1.append(int(np.sum(mix(u))))
                f2.append(int(np.bitwise_xor.reduce(mix(u + np.uint64(77)))) if len(u) else 0)
                if len(u):
                    least[r] = _samples(u, a, b)
            values = mix(least.astype(np.uint64) + lanes)
            keys = mix((values.reshape(-1, p.bands, p.rows) * weights).sum(axis=2, dtype=np.uint64) + salt)
            bit = (values >> np.uint64(64 - 9)).astype(np.int64) + np.arange(batch.num_rows)[:, None] * SKETCH_BITS
            odd = np.bincount(bit.ravel(), minlength=batch.num_rows * SKETCH_BITS).reshape(-1, SKETCH_BITS) & 1
            packed = np.packbits(odd.astype(np.uint8), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(f1, np.uint64).view(np.int64)),
                    pa.array(np.array(f2, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, p.bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))),
                    pa.array([x.tobytes() for x in packed], pa.binary()),
                ],
                names=["id", "text_key", "n", "fp1", "fp2", "bands", "sketch"],
            )

    return _rows(docs, id_col, text_col).mapInArrow(lean(run), "id long, text_key long, n long, fp1 long, fp2 long, bands array<long>, sketch binary")


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), _text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))


# ---------------------------------------------------------------- comparing groups in blocks

Near = Callable[[int, np.ndarray], np.ndarray]


def _forest(ids: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Edges that tie each member to the smallest id it is connected with, found breadth first.

    Each visited member is held against those not yet reached, so a group of alike members costs one sweep.
    """
    out: list[tuple[int, int]] = []
    left = np.argsort(ids, kind="stable")
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            hit = near(queue.pop(), left)
            found = left[hit]
            left = left[~hit]
            queue.extend(found)
            out.extend((int(ids[x]), int(ids[root])) for x in found)
    return out


def _by_sketch(sizes: np.ndarray, payloads: list[bytes], p: NearDup) -> Near:
    bits = np.frombuffer(b"".join(payloads), np.uint64).reshape(len(payloads), -1)
    most = p.most_different_bits

    def near(i: int, js: np.ndarray) -> np.ndarray:
        small, large = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
        return (100 * small >= p.percent * large) & (np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1) <= most)

    return near


def _by_set(sizes: np.ndarray, payloads: list[bytes], p: NearDup) -> Near:
    sets = [np.frombuffer(x, np.uint64) for x in payloads]

    def near(i: int, js: np.ndarray) -> np.ndarray:
        out = (100 * np.minimum(sizes[js], sizes[i]) >= p.percent * np.maximum(sizes[js], sizes[i])) & (sizes[js] > 0)
        at = np.flatnonzero(out)
        if len(at):
            own = sets[i]
            ends = np.cumsum(sizes[js[at]])
            every = np.concatenate([sets[j] for j in js[at]])
            place = np.searchsorted(own, every)
            place[place == len(own)] = 0
            shared = np.add.reduceat((own[place] == every).astype(np.int64), np.concatenate(([0], ends[:-1])))
            out[at] = 100 * shared >= p.percent * (sizes[js[at]] + sizes[i] - shared)
        return out

    return near


def _compare(tasks: DataFrame, p: NearDup, exact: bool) -> DataFrame:
    """Forest edges (a, b) within each task: rows of (t1, t2, t3, id, n, payload), dealt by task and sorted."""
    kind = _by_set if exact else _by_sketch

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sizes, payloads = None, [], [], []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(ids) > 1:
                where: dict[int, int] = {}
                for at, x in enumerate(ids):  # a leader may come twice
                    where.setdefault(x, at)
                keep = list(where.values())
                n = np.array([sizes[x] for x in keep], np.int64)
                out.extend(_forest(np.array([ids[x] for x in keep], np.int64), kind(n, [payloads[x] for x in keep], p)))

        def ready() -> pa.RecordBatch:
            unique = list(dict.fromkeys(out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in unique], pa.int64()), pa.array([x[1] for x in unique], pa.int64())], names=["a", "b"])

        for batch in batches:
            t1, t2, t3, bid, bn = (batch.column(x).to_pylist() for x in range(5))
            load = batch.column(5).to_pylist()
            for row in range(batch.num_rows):
                now = (t1[row], t2[row], t3[row])
                if now != key:
                    close()
                    key, ids, sizes, payloads = now, [], [], []
                ids.append(bid[row])
                sizes.append(bn[row])
                payloads.append(load[row])
            if len(out) > 10_000:
                yield ready()
        close()
        yield ready()

    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tasks.select("t1", "t2", "t3", "id", "n", "payload").repartition(parts, "t1", "t2", "t3").sortWithinPartitions("t1", "t2", "t3", "id")
    return dealt.mapInArrow(lean(run), "a long, b long")


def link_within(members: DataFrame, payloads: DataFrame, p: NearDup, exact: bool, bands: DataFrame | None = None) -> DataFrame:
    """(node, component) of whatever is connected by similarity within the groups; members that are like no other are absent.

    members: (grp, id), payloads: (id, n, payload), bands: (id, band). A group weighs as many rows, or shingles if `exact`, and is
    dealt out in blocks of bounded weight, its leader (smallest id) going to each block. Groups of one block
    are done then. In larger ones, members outside the leader's component meet all blocks of their group; if `bands` is given and that
    makes more pairs of blocks than there are bands, they meet those members of the group that share a band with them.
    """
    weight = F.col("n") if exact else F.lit(1)
    m = cut(members.join(payloads.select("id", "n"), "id"))
    edges, groups, m = _in_blocks(m, payloads, p, exact)
    parts = cut(connected_components(edges))
    wide = groups.filter("blocks > 1")
    if wide.isEmpty():
        return parts
    total = m.count()
    main = wide.join(parts, F.col("leader") == F.col("node"), "left").select("grp", "rows", F.coalesce("component", "leader").alias("main"))
    late = attach(m.filter("blocks > 1").select("grp", "id", "n"), main, "grp", total, "rows")
    late = cut(late.join(parts, F.col("id") == F.col("node"), "left").select("grp", "id", "n", (F.coalesce("component", "id") != F.col("main")).alias("rest")))
    late = _placed(late, p, exact)
    if bands is not None:
        # groups of more pairs of blocks than a document has bands
        spread = F.col("blocks").cast("long") * F.col("odd_blocks") > p.bands
        apart = late.filter(spread)
        if not apart.isEmpty():
            apart = apart.join(bands, "id").select(F.xxhash64("grp", "band").alias("grp"), "id", "n", "rest")
            late = late.filter(~spread).unionByName(_placed(cut(apart), p, exact))
    # a task is (block of the rest, block of the group); members of the main part need not meet one another
    to_all = late.filter("rest").select("grp", "id", F.pmod(F.xxhash64("id"), F.col("odd_blocks")).cast("int").alias("t2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t3"))
    from_all = late.select("grp", "id", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)).alias("t2"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("t3"))
    second = to_all.unionByName(from_all).distinct().withColumnRenamed("grp", "t1")
    return _joined(parts, _compare(second.join(payloads, "id"), p, exact))


def _joined(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) after more edges (a, b): only edges between different components count, as edges of components."""
    ends = edges.distinct()
    for end in ("a", "b"):
        of = parts.select(F.col("node").alias(end), F.col("component").alias("of"))
        ends = ends.join(of, end, "left").withColumn(f"of_{end}", F.coalesce("of", end)).drop("of")
    ends = cut(ends)
    between = cut(connected_components(ends.filter("of_a <> of_b").select("of_a", "of_b"), "of_a", "of_b"))
    nodes = parts.unionByName(ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("of_a").alias("component")), F.struct(F.col("b").alias("node"), F.col("of_b").alias("component")))).alias("x")).select("x.*")).distinct()
    new = between.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return nodes.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def _placed(late: DataFrame, p: NearDup, exact: bool) -> DataFrame:
    """(grp, id, n, rest) of groups of two or more that have a rest, with the numbers of blocks of the group and of its rest."""
    weight, most = F.col("n") if exact else F.lit(1), p.block_rows if exact else p.late_rows

    def blocks(weight: Column, rows: Column) -> Column:
        return (F.greatest(F.ceil(weight / p.block_shingles), F.ceil(rows / most)) if exact else F.ceil(rows / most)).cast("int")

    odd = F.when(F.col("rest"), weight)
    counts = late.groupBy("grp").agg(F.count("*").alias("rows"), F.sum(weight).alias("weight"), F.sum(odd).alias("odd"), F.count(odd).alias("odd_rows")).filter("odd_rows > 0 and rows > 1")
    counts = cut(counts.select("grp", "rows", blocks(F.col("weight"), F.col("rows")).alias("blocks"), blocks(F.col("odd"), F.col("odd_rows")).alias("odd_blocks")))
    return cut(attach(late, counts, "grp", late.count(), "rows"))


def _in_blocks(m: DataFrame, payloads: DataFrame, p: NearDup, exact: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges within blocks of each group, to each of which its leader goes; the groups of two or more; (grp, id, n) with the group's columns."""
    total, weight = m.count(), F.col("n") if exact else F.lit(1)
    blocks = F.greatest(F.ceil(F.col("weight") / p.block_shingles), F.ceil(F.col("rows") / p.block_rows)) if exact else F.ceil(F.col("weight") / p.block_rows)
    groups = m.groupBy("grp").agg(F.count("*").alias("rows"), F.sum(weight).alias("weight"), F.min("id").alias("leader")).filter("rows > 1")
    groups = cut(groups.select("grp", "rows", "leader", blocks.cast("int").alias("blocks")))
    m = cut(attach(m, groups, "grp", total, "rows"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    first = m.select("grp", "id", F.explode(F.when(F.col("id") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("t2"))
    first = first.select(F.col("grp").alias("t1"), "t2", F.lit(-1).alias("t3"), "id")
    return _compare(first.join(payloads, "id"), p, exact), groups, m


def _buckets(classes: DataFrame) -> DataFrame:
    """(grp, id) of band keys that two or more classes share."""
    rows = classes.select("id", F.explode("bands").alias("grp"))
    shared = rows.groupBy("grp").agg(F.count("*").alias("rows")).filter("rows > 1")
    return rows.join(shared.select("grp"), "grp")


# ---------------------------------------------------------------- the operator


def _verdicts(docs: DataFrame, p: NearDup, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n_shingles, component_id, kept), one row per row of docs."""
    sig = cut(signatures(docs, p, id_col, text_col))
    full = sig.filter("n > 0 and id is not null")
    # an id may have several texts, so a class has a number, not the id that stands for it
    classes = full.groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    own = full.join(classes.select("fp1", "fp2", "n", "rep", "node"), ["fp1", "fp2", "n"]).filter("id = rep").dropDuplicates(["node"])
    own = cut(own.select(F.col("node").alias("id"), "n", "bands", F.col("sketch").alias("payload"), "rep", "text_key"))
    candidates = link_within(_buckets(own), own.select("id", "n", "payload"), p, exact=False)
    candidates = cut(candidates.withColumnsRenamed({"node": "id", "component": "grp"}))
    of_candidates = own.select("id", "n", "bands", "rep", "text_key").join(candidates.select("id"), "id", "left_semi")
    sets = cut(_full_sets(docs, of_candidates.select("id", "rep", "text_key"), p, id_col, text_col))
    linked = link_within(candidates, sets, p, exact=True, bands=of_candidates.select("id", F.explode("bands").alias("band")))
    linked = cut(linked.join(classes.select("node", "rep"), "node"))
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    names = attach(linked.select("component", "node"), least, "component", linked.count()).select("node", "component_id")
    classes = classes.join(names, "node", "left").select("fp1", "fp2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    rows = sig.select("id", "text_key", "n", "fp1", "fp2").join(classes, ["fp1", "fp2", "n"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    out = rows.select("id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, p: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of docs.

    A null or blank text has an empty set and is linked with nothing; a text of fewer words than a shingle
    has the whole sequence as its one shingle. Rows that repeat an id with the same text behave as one
    document; with different texts each goes by its own text, and `kept` says whether the id is the smallest of its component.
    A row without id is a document of its own: component_id null, kept true. Other columns of docs
    are not looked at.
    """
    return _verdicts(docs, p, id_col, text_col).drop("text_key")


def without_copies(docs: DataFrame, p: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps. Rows go by their id and text, so that of rows with the same
    id those with a text of their own stay."""
    gone = _verdicts(docs, p, id_col, text_col).filter("not kept").select("id", "text_key").distinct()
    a, b = free_name(docs, "gone_id"), free_name(docs, "gone_text")
    gone = gone.toDF(a, b)
    return docs.join(gone, (F.col(f"`{id_col}`").cast("long") == F.col(a)) & (_text_key(text_col) == F.col(b)), "left_anti")


def _full_sets(docs: DataFrame, wanted: DataFrame, p: NearDup, id_col: str, text_col: str) -> DataFrame:
    """(id, n, payload) with the whole shingle set of each wanted class: (id, rep, text_key), a document that stands for it.

    A row that repeats is left out where its task has seen it; the rest of such repeats does no harm.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            new = [i for i, x in enumerate(ids) if not (x in seen or seen.add(x))]
            batch = batch.take(pa.array(new, pa.int64()))
            step = 256  # a set can be several times the size of its text
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                sets = list(_sets(part.column(1), p.shingle))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "n", "payload"])

    rows = _rows(docs, id_col, text_col).withColumnRenamed("id", "rep")
    return rows.join(wanted, ["rep", "text_key"]).select("id", "text").mapInArrow(lean(run), "id long, n long, payload binary")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, by 3-word shingles at 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op6_near_dup": op6_near_dup}
