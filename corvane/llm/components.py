"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps attach a node's least neighbour to its rows: a partial aggregate and a join. `attach` splits the rows of nodes that have
very many into shares, so no task sees more than about a thousandth of all rows of one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: A key with more than this share of all rows, and more rows than LEAST, is heavy: there are at most SHARES heavy keys.
SHARES = 1000
LEAST = 100


def attach(rows: DataFrame, per_key: DataFrame, key: str, total: int, weight: str = "n") -> DataFrame:
    """rows joined with the row of per_key that has the same key; `weight` is the number of rows with that key, and goes.

    Heavy keys (at most SHARES, which are broadcast) are dealt out in shares of about total / SHARES rows, and their row of per_key is
    copied to each share, at most 2 * SHARES copies in all. Null keys match nothing.
    """
    limit = max(LEAST, total // SHARES)
    share, shares = free_name(rows, "key_share"), free_name(rows, "key_shares")
    cut_up = F.ceil(F.col(weight) / limit).cast("int")
    heavy = per_key.filter(F.col(weight) > limit).select(key, cut_up.alias(shares))
    rows = rows.join(F.broadcast(heavy), key, "left")
    rows = rows.withColumn(share, F.when(F.col(shares).isNull(), 0).otherwise(F.pmod(F.xxhash64(*[c for c in rows.columns if c not in (key, shares)]), F.col(shares)))).drop(shares)
    copies = per_key.withColumn(share, F.explode(F.when(F.col(weight) > limit, F.sequence(F.lit(0), cut_up - 1)).otherwise(F.array(F.lit(0))))).drop(weight)
    return rows.join(copies, [key, share]).drop(share)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, component): component is the smallest node that can be reached. Nodes without edges are absent.

    Null ends and loops are ignored, repeated edges count once. Each round is checkpointed.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e = cut(e)
    before = _state(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e, before[0]), before[0]))
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def _large_star(e: DataFrame, total: int) -> DataFrame:
    """Every neighbour larger than u is tied to the smallest of u and its neighbours."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return attach(both, least, "u", total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame, total: int) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them. In e, v is always smaller than u."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = attach(e, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
