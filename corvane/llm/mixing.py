"""Mixing sources to target weights by Poisson replication.

A source of n documents that shall make up a share w of the mixture is repeated at the rate w * total / n on average. Each
document draws its own count: a uniform number from a hash of its id and the seed goes through the inverse of the
source's Poisson distribution. The draw needs no state, no order and no shuffle, and a lost task repeats it exactly.
Copies are then dealt out by a second hash and sorted by it, which is a global shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, let, shared_path, table


@dataclass(frozen=True)
class Mixture:
    """Target weights of sources, or by default the square root of each source's number of documents.

    weights: a source that isn't named gets 0 if weights are given, and its documents go. size: documents of the
    mixture, by default as many as there are. max_sources bounds the sources whose distributions become literals of the
    plan; beyond it they are joined.
    """

    weights: Mapping[str | None, float] | None = None
    size: int | None = None
    seed: int = 42
    exponent: float = 0.5
    max_sources: int = 2000


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until it can't be told from 1 in 52 bits."""
    if rate <= 0:
        return [1.0]
    out, total, k = [], 0.0, 0
    while total < 1 - 2.0**-52 and k <= rate + 40 * math.sqrt(rate) + 60:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(min(total, 1.0))
        k += 1
    return out


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 digest of the parts, with 52 bits."""
    word = F.conv(F.substr(F.md5(F.concat_ws(":", *parts)), F.lit(1), F.lit(13)), 16, 10).cast("long")
    return (word + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, p: Mixture = Mixture(), source_col: str = "source") -> DataFrame:
    """(source, n, rate) of every source, counted over all documents. Null is a source like any other."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if p.weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(p.exponent))
    else:
        weight = F.lit(0.0)
        for name, w in p.weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = cut(counts.withColumn("w", weight))  # a row per source
    total = counts.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    size = p.size if p.size is not None else total.n
    rate = F.col("w") / F.lit(total.w) * F.lit(size) / F.col("n") if total.w else F.lit(0.0)
    return counts.select("source", "n", rate.alias("rate"))


def replicate(docs: DataFrame, p: Mixture = Mixture(), id_col: str = "doc_id", source_col: str = "source", copy: str = "copy", n_copies: str = "n_copies") -> DataFrame:
    """docs with one row per copy and two more columns, the last ones: `n_copies` and `copy` from 1, underscored where docs has
    columns of these names; not shuffled yet.

    Rows that repeat an id draw the same count, a null id draws as the text "null". A document whose draw is 0 has no copy.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    u = uniform(key, F.lit(str(p.seed)))
    chosen = rates(docs, p, source_col)
    rows = chosen.limit(p.max_sources + 1).collect()
    source = F.col(source_col).cast("string")
    # the count is the number of k with P(X <= k) < u
    if len(rows) <= p.max_sources:
        tables = [(r.source, poisson_cdf(r.rate)) for r in rows]
        null = next((c for s, c in tables if s is None), [1.0])
        named = [(s, c) for s, c in tables if s is not None]
        cdf = F.array(*map(F.lit, null))
        if named:
            known = F.map_from_entries(F.array(*[F.struct(F.lit(s).alias("k"), F.array(*map(F.lit, c)).alias("v")) for s, c in named]))
            cdf = F.when(source.isNull(), cdf).otherwise(F.try_element_at(known, source))
        d = docs
        extra: list[str] = []
    else:
        name, table_of = free_name(docs, "mix_source"), free_name(docs, "mix_cdf")
        d = docs.join(_with_cdf(chosen).select(F.col("source").alias(name), F.col("cdf").alias(table_of)), source.eqNullSafe(F.col(name)))
        extra = [name, table_of]
        cdf = F.col(table_of)
    count, at = free_name(d, n_copies), free_name(d, copy)
    d = d.withColumn(count, let(u, lambda x: F.size(F.filter(cdf, lambda c: c < x)))).filter(F.col(count) > 0)
    return d.withColumn(at, F.explode(F.sequence(F.lit(1), F.col(count)))).drop(*extra).select(*[F.col(f"`{c}`") for c in docs.columns], count, at)


def _with_cdf(chosen: DataFrame) -> DataFrame:
    """(source, cdf): poisson_cdf() of every source, for more sources than a plan should hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rate in enumerate(batch.column(1).to_pylist()):  # a source each: its list may be long
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([poisson_cdf(rate)], pa.list_(pa.float64()))], names=["source", "cdf"])

    return chosen.select("source", "rate").mapInArrow(run, "source string, cdf array<double>")


def shuffled(copies: DataFrame, p: Mixture = Mixture(), id_col: str = "doc_id", copy: str = "copy", key: str = "shuffle_key") -> DataFrame:
    """The copies in a random global order that depends on the seed alone; `key` is what they are sorted by, underscored where
    there is a column of this name. `copy` is the column of that name that replicate() added."""
    word = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy).cast("string"), F.lit(str(p.seed)), F.lit("order")))
    key = free_name(copies, key)
    return copies.withColumn(key, word).orderBy(key)


def mix(docs: DataFrame, p: Mixture = Mixture(), id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mixture: the columns of docs, one row per copy, in random global order."""
    copies = replicate(docs, p, id_col, source_col)
    return shuffled(copies, p, id_col, copies.columns[-1]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of the mixture in its order. The mixture itself, whole documents in that order, is stored and listed from there."""
    path = shared_path(spark, "mixture")
    shuffled(replicate(table(spark, sf_dir, "documents"))).write.parquet(path)
    return spark.read.parquet(path).select("doc_id", "source", "copy", "n_copies", "shuffle_key").orderBy("shuffle_key")


_SQL = """
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
k AS (SELECT source, unnest(range(0, CAST(ceil(rate + 40 * sqrt(rate) + 60) AS BIGINT) + 1)) AS k, rate FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
l AS (SELECT source, list(cdf ORDER BY k) AS cdfs FROM c GROUP BY source),
u AS (SELECT doc_id, source, (CAST('0x' || substr(md5(concat_ws(':', doc_id, '42')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
d AS (SELECT doc_id, u.source, CAST(len(list_filter(cdfs, lambda x: x < u)) AS INTEGER) AS n_copies FROM u JOIN l ON u.source IS NOT DISTINCT FROM l.source),
x AS (SELECT doc_id, source, n_copies, CAST(unnest(range(1, n_copies + 1)) AS INTEGER) AS copy FROM d WHERE n_copies > 0)
SELECT doc_id, source, copy, n_copies, md5(concat_ws(':', doc_id, copy, '42', 'order')) AS shuffle_key FROM x
"""
ORACLE = {"op2_mix": _SQL}
QUERIES = {"op2_mix": op2_mix}
