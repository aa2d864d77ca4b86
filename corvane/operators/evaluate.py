"""How good retrieval is: exact top-k search, Hit@K and MRR, comparisons, recommendations and training curves."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KS = (1, 3, 5, 10)
#: Queries that are searched in one pass over the corpus; their vectors are sent to the workers.
BLOCK = 2000
#: Rows of the corpus, and scores, that a worker has in its temporaries at once.
ROWS, SCORES = 2048, 1 << 18
_DIGITS = 9


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally many numbers, from the Arrow buffer. Vectors of other lengths are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, np.float64).reshape(len(column), -1 if len(column) else 0)


def _scores(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Rounded, so that equal vectors score alike in any order of summation. Greater is nearer."""
    dot = queries @ corpus.T
    if metric == "dot":
        return np.round(dot, _DIGITS)
    squares = (queries**2).sum(axis=1)[:, None] + (corpus**2).sum(axis=1)[None, :] - 2 * dot
    return -np.round(squares, _DIGITS)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of each row with their ids, ties to the smaller id; rows of fewer are filled up with -inf."""
    if score.shape[1] > k:
        least = np.partition(score, -k, axis=1)[:, -k]
        row, at = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    else:
        row, at = np.nonzero(score > -np.inf)
    order = np.lexsort((ids[row, at], -score[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, at, place = row[place < k], at[place < k], place[place < k]
    best, found = np.full((len(score), k), -np.inf), np.zeros((len(score), k), np.int64)
    best[row, place], found[row, place] = score[row, at], ids[row, at]
    return best, found


def _search(batches: Iterable[pa.RecordBatch], ids: np.ndarray, vectors: np.ndarray, k: int, metrics: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(metric, query_id, vec_id, score): the k best of the batches for each query, in tiles of at most SCORES scores, however many queries are sent
    and however many rows tie."""
    best = {m: (np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)) for m in metrics}
    tile = max(1, SCORES // ROWS)
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            own = batch.column(0).to_numpy()
            matrix = _matrix(batch.column(1))
            for first in range(0, len(ids), tile):
                some = slice(first, first + tile)
                itself = ids[some, None] == own[None, :]
                for m, (score, found) in best.items():
                    new = _scores(vectors[some], matrix, m)
                    new[itself] = -np.inf
                    score[some], found[some] = _best(np.hstack((score[some], new)), np.hstack((found[some], np.broadcast_to(own, new.shape))), k)
    for m, (score, found) in best.items():
        keep = np.isfinite(score).ravel()
        n = int(keep.sum())
        yield pa.RecordBatch.from_arrays([pa.array([m] * n, pa.string()), pa.array(np.repeat(ids, k)[keep]), pa.array(found.ravel()[keep]), pa.array(score.ravel()[keep])], names=["metric", "query_id", "vec_id", "score"])


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str | tuple[str, ...] = "dot", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, rank): the k nearest rows of the corpus for each query, itself excepted; ties go to the smaller id.

    Exact. Queries are taken in blocks of bounded size, each of which is held against every row of the corpus in one pass
    without a shuffle; every task leaves k candidates a query, and only those are ranked. A worker holds one block,
    its candidates and a tile of scores, however many rows there are. Null vectors don't take part. With several metrics, all are scored
    in the same pass and a column `metric` names them.
    """
    spark = corpus.sparkSession
    metrics = (metric,) if isinstance(metric, str) else tuple(metric)
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    c = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    schema = "metric string, query_id long, vec_id long, score double"
    passes = []
    blocks = -(-q.count() // BLOCK)
    for b in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], np.float64)))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return _search(batches, *sent.value, k, metrics)

        passes.append(c.mapInArrow(run, schema))
    if not passes:  # createDataFrame() would start Python workers of another kind for no rows, which stay for a while
        passes = [spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields])]
    out = reduce(DataFrame.unionByName, passes)
    w = Window.partitionBy("metric", "query_id").orderBy(F.col("score").desc(), "vec_id")
    named = [] if isinstance(metric, str) else ["metric"]
    return out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select(*named, "query_id", "vec_id", "rank")


def first_ranks(results: DataFrame, relevant: Column, queries: DataFrame, query: str = "query_id") -> DataFrame:
    """(query_id, first_rank) of each query; null if nothing relevant was found."""
    hit = results.groupBy(query).agg(F.min(F.when(relevant, F.col("rank"))).alias("first_rank"))
    return queries.select(query).distinct().join(hit, query, "left")


def hit_and_mrr(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_queries, hit_at_1 ... hit_at_10 and mrr over all queries; a query without a hit counts as a miss."""
    r = F.col("first_rank")
    hits = [F.round(F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit_at_{k}") for k in KS]
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n_queries"), *hits, F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"))


def with_failures(ranks: DataFrame, failed: DataFrame, query: str = "query_id") -> DataFrame:
    """Metrics twice: `_successful` without the failed queries and `_all` with them as misses."""
    bad = failed.select(query).distinct().withColumn("bad", F.lit(True))
    r = ranks.join(bad, query, "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    ok = hit_and_mrr(r.filter("not bad"))
    full = hit_and_mrr(r.withColumn("first_rank", F.when(~F.col("bad"), F.col("first_rank"))))
    a, b = ok.select(*[F.col(c).alias(f"{c}_successful") for c in ok.columns]), full.select(*[F.col(c).alias(f"{c}_all") for c in full.columns])
    return a.crossJoin(F.broadcast(b))  # one row each


def hit_band(x: Column) -> Column:
    return F.when(x >= 0.9, "excellent").when(x >= 0.7, "good").otherwise("poor")


def mrr_band(x: Column) -> Column:
    """Exactly 0.8 falls in no band."""
    return F.when(x > 0.8, "excellent").when((x >= 0.6) & (x < 0.8), "good").when(x < 0.6, "poor")


def paired_test(pairs: DataFrame, before: str, after: str, by: list[str] | None = None) -> DataFrame:
    """n, effect, t, a 95 % interval of after - before and p; t by the sample's deviation, the interval by the population's.

    Without variance t and p are null.
    """
    d = F.col(after).cast("double") - F.col(before).cast("double")
    one = pairs.groupBy(*(by or [])).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.stddev_pop(d).alias("p"))
    half = F.lit(1.96) * F.col("p") / F.sqrt("n")
    t = F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n")))
    return one.select(
        *(by or []), "n", F.round("m", 6).alias("effect"), F.round(t, 6).alias("t"), F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"), F.round(p_value(t, F.col("n")), 6).alias("p")
    )


#: Steps of Simpson's rule, an even number.
STEPS = 2000


def p_value(t: Column, n: Column) -> Column:
    """Two-sided p of Student's t with n - 1 degrees of freedom, in built-in functions: one less the share of cos(x)^(n-2) that lies
    below atan(t / sqrt(n - 1)), both integrals by Simpson's rule."""
    free = n - 1

    def area(to: Column) -> Column:
        weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return to * F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda sum_, i: sum_ + weight(i) * F.pow(F.cos(to * i / STEPS), free - 1))

    end = F.least(F.lit(math.pi / 2), 40 / F.sqrt(free))  # beyond that nothing is left
    inside = F.least(F.atan(F.abs(t) / F.sqrt(free)), end)
    return F.when(t.isNotNull() & (n > 1), F.greatest(F.lit(0.0), 1 - area(inside) / area(end)))


def t_p_value(t: float | None, n: int) -> float | None:
    """Two-sided p of Student's t with n - 1 degrees of freedom, by the incomplete beta function."""
    if t is None or n < 2:
        return None
    nu = n - 1
    return _beta(nu / (nu + t * t), nu / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d), 1 + top / c
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def compare(metrics: DataFrame, run: str, before: str, after: str, metric: str = "metric", value: str = "value") -> DataFrame:
    """(metric, before, after, change, percent) of two runs; metrics that one lacks have nulls."""
    g = metrics.groupBy(metric).agg(F.max(F.when(F.col(run) == before, F.col(value))).alias("before"), F.max(F.when(F.col(run) == after, F.col(value))).alias("after"))
    return g.filter("before is not null or after is not null").withColumn("change", F.round(F.col("after") - F.col("before"), 6)).withColumn("percent", F.round(F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100), 4))


def reject_reasons(models: DataFrame, min_hit: float, max_ms: float, max_mb: float) -> DataFrame:
    """models with `reasons`, the limits that each one breaks; an unknown value breaks its limit."""
    reasons = F.array(
        F.when(~F.coalesce(F.col("hit_at_10") >= min_hit, F.lit(False)), F.lit("hit")),
        F.when(~F.coalesce(F.col("latency_ms") <= max_ms, F.lit(False)), F.lit("latency")),
        F.when(~F.coalesce(F.col("ram_mb") <= max_mb, F.lit(False)), F.lit("memory")),
    )
    return models.withColumn("reasons", F.array_join(F.filter(reasons, lambda x: x.isNotNull()), ","))


def recommend(models: DataFrame, min_hit: float, max_ms: float, max_mb: float) -> DataFrame:
    """The model of the best Hit@10 within the limits; ties go to the faster one, then by name. Empty if none fits."""
    ok = reject_reasons(models, min_hit, max_ms, max_mb).filter("reasons = ''").drop("reasons")
    return ok.orderBy(F.col("hit_at_10").desc(), "latency_ms", "model").limit(1)


def efficiency(models: DataFrame) -> DataFrame:
    """Hit@10 per GB of memory and per second."""
    return models.select("model", F.round(F.when(F.col("ram_mb") > 0, F.col("hit_at_10") / (F.col("ram_mb") / 1024)), 6).alias("hit_per_gb"), F.round(F.when(F.col("latency_ms") > 0, F.col("hit_at_10") / (F.col("latency_ms") / 1000)), 6).alias("hit_per_s"))


def disk_mb(size: Column) -> Column:
    return size / F.lit(1_000_000)


def recomputed(raw: DataFrame, saved: DataFrame, keys: list[str], tolerance: float = 1e-3) -> DataFrame:
    """saved joined with raw (keys, value) and whether they agree; a metric that either side lacks doesn't."""
    j = saved.withColumnRenamed("value", "saved").join(raw.withColumnRenamed("value", "again"), keys, "full_outer")
    return j.withColumn("agrees", F.coalesce(F.abs(F.col("saved") - F.col("again")) <= tolerance, F.lit(False)))


def early_stopping(steps: DataFrame, run: str, order: list[str], loss: str, factor: float = 1.05, patience: int = 3) -> DataFrame:
    """Per run the step at which training stops: the last of `patience` steps in a row above factor times the best loss so far.

    (run, *order) of that step; runs that go through have no row.
    """
    w = Window.partitionBy(run).orderBy(*order)
    s = steps.withColumn("best", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("bad", F.coalesce(F.col(loss) > F.col("best") * factor, F.lit(False)))
    s = s.withColumn("row", F.sum(F.col("bad").cast("int")).over(w.rowsBetween(-(patience - 1), 0)))
    first = s.filter(F.col("row") == patience).groupBy(run).agg(F.min(F.struct(*order)).alias("x"))
    return first.select(run, *[F.col("x")[c].alias(c) for c in order])


def best_checkpoint(steps: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """Per run the step of the least loss; ties go to the earlier step."""
    return steps.groupBy(run).agg(F.min(F.struct(loss, step)).alias("x")).select(run, F.col("x")[step].alias(step), F.col("x")[loss].alias(loss))


# ---------------------------------------------------------------- queries over the driver's tables


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e, e.filter("vec_id % 100 = 0")


def _searched(spark: SparkSession, d: str, metric: str | tuple[str, ...] = "dot") -> DataFrame:
    """Results with the labels of the query and of what was found."""
    e, q = _vectors(spark, d)
    found = top_k(e.select("vec_id", "embedding"), q, metric=metric)
    found = found.join(e.select("vec_id", "label"), "vec_id")
    return found.join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


def _ranks(spark: SparkSession, d: str, metric: str = "dot") -> DataFrame:
    _, q = _vectors(spark, d)
    return first_ranks(_searched(spark, d, metric), F.col("label") == F.col("query_label"), q.select(F.col("vec_id").alias("query_id")))


def retrieval_topk(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d).select("query_id", "rank", "vec_id", (F.col("label") == F.col("query_label")).alias("relevant"))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return hit_and_mrr(_ranks(spark, d))


def retrieval_by_label(spark: SparkSession, d: str) -> DataFrame:
    _, q = _vectors(spark, d)
    return hit_and_mrr(_ranks(spark, d).join(q.select(F.col("vec_id").alias("query_id"), "label"), "query_id"), ["label"])


def retrieval_failures(spark: SparkSession, d: str) -> DataFrame:
    _, q = _vectors(spark, d)
    return with_failures(_ranks(spark, d), q.filter("label = 3").select(F.col("vec_id").alias("query_id")))


def metric_bands(spark: SparkSession, d: str) -> DataFrame:
    m = retrieval_by_label(spark, d)
    return m.select("label", hit_band(F.col("hit_at_10")).alias("hit_band"), mrr_band(F.col("mrr")).alias("mrr_band"))


def _both(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, dot, l2): the first rank of something relevant by either metric, from one search."""
    _, q = _vectors(spark, d)
    found = _searched(spark, d, ("dot", "l2")).filter(F.col("label") == F.col("query_label"))
    ranks = found.groupBy("query_id").agg(*[F.min(F.when(F.col("metric") == m, F.col("rank"))).alias(m) for m in ("dot", "l2")])
    return q.select(F.col("vec_id").alias("query_id")).join(ranks, "query_id", "left")


def paired_ttest(spark: SparkSession, d: str) -> DataFrame:
    """Hit@10 of each query by dot product and by distance."""
    a, b = (F.coalesce((F.col(m) <= 10).cast("int"), F.lit(0)) for m in ("dot", "l2"))
    return paired_test(_both(spark, d).select(a.alias("a"), b.alias("b")), "a", "b")


def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    """Searches by distance and by dot product, metric by metric, with the p of the paired test over the queries."""
    ranks = _both(spark, d)

    def values(rank: Column) -> list[Column]:
        return [*[F.coalesce((rank <= k).cast("double"), F.lit(0.0)) for k in KS], F.coalesce(1.0 / rank, F.lit(0.0))]

    names = [f"hit_at_{k}" for k in KS] + ["mrr"]
    each = F.array(*[F.struct(F.lit(n).alias("metric"), a.alias("a"), b.alias("b")) for n, a, b in zip(names, values(F.col("dot")), values(F.col("l2")), strict=True)])
    pairs = ranks.select(F.explode(each).alias("x")).select("x.*")
    means = pairs.groupBy("metric").agg(F.round(F.avg("a"), 6).alias("a"), F.round(F.avg("b"), 6).alias("b"))
    long = means.select("metric", F.explode(F.array(F.struct(F.lit("base").alias("run"), F.col("a").alias("value")), F.struct(F.lit("new").alias("run"), F.col("b").alias("value")))).alias("x")).select("metric", "x.*")
    return compare(long, "run", "base", "new").join(paired_test(pairs, "a", "b", ["metric"]).select("metric", "p"), "metric")


#: Limits that some of the models below keep and some don't.
_LEAST, _SLOWEST, _MOST = 0.695, 50.2, 505.0


def _models(spark: SparkSession, d: str) -> DataFrame:
    """Event types as models: the share of low values as Hit@10, the mean as latency, a thousand times the share of even users as memory."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg((F.col("value") < 60).cast("double")), 6).alias("hit_at_10"), F.round(F.avg("value"), 6).alias("latency_ms"), F.round(1000 * F.avg((F.col("user_id") % 2 == 0).cast("double")), 6).alias("ram_mb"))


def model_rejections(spark: SparkSession, d: str) -> DataFrame:
    return reject_reasons(_models(spark, d), _LEAST, _SLOWEST, _MOST).select("model", "reasons")


def recommend_model(spark: SparkSession, d: str) -> DataFrame:
    return recommend(_models(spark, d), _LEAST, _SLOWEST, _MOST).select("model")


def efficiency_ratios(spark: SparkSession, d: str) -> DataFrame:
    return efficiency(_models(spark, d))


def ablation(spark: SparkSession, d: str) -> DataFrame:
    """Orders by priority and the number of their lines: the mean price, as a table of training size against a metric."""
    o, li = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    n = li.groupBy("l_orderkey").agg(F.count("*").alias("size"))
    return o.join(n, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority", "size").agg(F.count("*").alias("runs"), F.round(F.avg("o_totalprice"), 4).alias("mean_metric"))


def recomputed_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Means of days against what was saved: with three digits, on every third day a bit off, and not at all on every seventh."""
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("value"))
    number = F.substr("day", F.lit(9), F.lit(2)).cast("int")
    saved = e.filter(number % 7 != 0).withColumn("value", F.round("value", 3) + F.when(number % 3 == 0, 0.002).otherwise(0.0))
    return recomputed(e, saved, ["day"]).select("day", "agrees")


def early_stops(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "value")
    return early_stopping(e, "user_id", ["ts", "event_id"], "value").select("user_id", "event_id")


def best_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return best_checkpoint(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


def debug_case(spark: SparkSession, d: str) -> DataFrame:
    """All that is known of the first query: its results with their labels."""
    first = _vectors(spark, d)[1].agg(F.min("vec_id").alias("query_id"))
    return _searched(spark, d).join(F.broadcast(first), "query_id", "left_semi").select("query_id", "query_label", "rank", "vec_id", "label")  # one row


def _sql(score: str) -> str:
    return f"""q AS (SELECT vec_id AS query_id, label AS query_label, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS cv FROM embeddings),
    s AS (SELECT query_id, query_label, vec_id, label, row_number() OVER (PARTITION BY query_id ORDER BY {score}, vec_id) AS rank FROM q JOIN c ON query_id <> vec_id QUALIFY rank <= 10),
    f AS (SELECT q.query_id, q.query_label, min(rank) FILTER (label = s.query_label) AS first_rank FROM q LEFT JOIN s USING (query_id) GROUP BY 1, 2)"""


#: p of Student's t: the share of 200,000 strips of the density between -t and t, taken from 1; the factor before it by logarithms of gamma.
_P = """CASE WHEN s > 0 THEN round(greatest(0, 1 - 2 * (SELECT sum(exp(lgamma(n / 2) - lgamma((n - 1) / 2) - 0.5 * ln((n - 1) * pi()) - n / 2 * ln(1 + ((i + 0.5::DOUBLE) / 200000 * abs(m / (s / sqrt(n)))) ** 2 / (n - 1)))) / 200000 * abs(m / (s / sqrt(n))) FROM range(200000) r(i))), 6) END"""
_DOT, _L2 = _sql("round(list_dot_product(qv, cv), 9) DESC"), _sql("round(list_distance(qv, cv) ** 2, 9)")
_M = "count(*) AS n_queries, " + ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_{k}" for k in KS) + ", round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr"
_MODELS = "m AS (SELECT event_type AS model, round(avg(CASE WHEN value < 60 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_10, round(avg(value), 6) AS latency_ms, round(1000 * avg(CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ram_mb FROM events GROUP BY 1)"
ORACLE = {
    "retrieval_topk": f"WITH {_DOT} SELECT query_id, rank, vec_id, label = query_label AS relevant FROM s",
    "retrieval_metrics": f"WITH {_DOT} SELECT {_M} FROM f",
    "retrieval_by_label": f"WITH {_DOT} SELECT query_label AS label, {_M} FROM f GROUP BY 1",
    "retrieval_failures": f"WITH {_DOT}, a AS (SELECT {_M} FROM f WHERE query_label <> 3), b AS (SELECT {_M} FROM (SELECT CASE WHEN query_label <> 3 THEN first_rank END AS first_rank FROM f)) SELECT "
    + ", ".join(f"a.{c} AS {c}_successful, b.{c} AS {c}_all" for c in ["n_queries", *[f"hit_at_{k}" for k in KS], "mrr"])
    + " FROM a, b",
    "metric_bands": f"WITH {_DOT}, m AS (SELECT query_label AS label, {_M} FROM f GROUP BY 1) SELECT label, CASE WHEN hit_at_10 >= 0.9 THEN 'excellent' WHEN hit_at_10 >= 0.7 THEN 'good' ELSE 'poor' END AS hit_band, CASE WHEN mrr > 0.8 THEN 'excellent' WHEN mrr >= 0.6 AND mrr < 0.8 THEN 'good' WHEN mrr < 0.6 THEN 'poor' END AS mrr_band FROM m",
    "paired_ttest": f"""WITH a AS (WITH {_DOT} SELECT query_id, CASE WHEN first_rank <= 10 THEN 1 ELSE 0 END AS a FROM f), b AS (WITH {_L2} SELECT query_id, CASE WHEN first_rank <= 10 THEN 1 ELSE 0 END AS b FROM f),
        p AS (SELECT count(*) AS n, avg(CAST(b - a AS DOUBLE)) AS m, stddev_samp(b - a) AS s, stddev_pop(b - a) AS p FROM a JOIN b USING (query_id))
        SELECT n, round(m, 6) AS effect, CASE WHEN s > 0 THEN round(m / (s / sqrt(n)), 6) END AS t, round(m - 1.96 * p / sqrt(n), 6) AS low, round(m + 1.96 * p / sqrt(n), 6) AS high, {_P} AS p FROM p""",
    "compare_runs": f"""WITH a AS (WITH {_DOT} SELECT query_id, first_rank AS r FROM f), b AS (WITH {_L2} SELECT query_id, first_rank AS r FROM f),
        x AS (SELECT a.r AS a, b.r AS b FROM a JOIN b USING (query_id)),
        v AS ({" UNION ALL ".join(f"SELECT 'hit_at_{k}' AS metric, CASE WHEN a <= {k} THEN 1.0::DOUBLE ELSE 0 END AS a, CASE WHEN b <= {k} THEN 1.0::DOUBLE ELSE 0 END AS b FROM x" for k in KS)} UNION ALL SELECT 'mrr', coalesce(1.0::DOUBLE / a, 0), coalesce(1.0::DOUBLE / b, 0) FROM x),
        g AS (SELECT metric, round(avg(a), 6) AS before, round(avg(b), 6) AS after, count(*) AS n, avg(b - a) AS m, stddev_samp(b - a) AS s FROM v GROUP BY 1)
        SELECT metric, before, after, round(after - before, 6) AS change, CASE WHEN before <> 0 THEN round((after - before) / before * 100, 4) END AS percent, {_P} AS p FROM g""",
    "model_rejections": f"WITH {_MODELS} SELECT model, array_to_string(list_filter([CASE WHEN hit_at_10 < 0.695 THEN 'hit' END, CASE WHEN latency_ms > 50.2 THEN 'latency' END, CASE WHEN ram_mb > 505 THEN 'memory' END], lambda x: x IS NOT NULL), ',') AS reasons FROM m",
    "recommend_model": f"WITH {_MODELS} SELECT model FROM m WHERE hit_at_10 >= 0.695 AND latency_ms <= 50.2 AND ram_mb <= 505 ORDER BY hit_at_10 DESC, latency_ms, model LIMIT 1",
    "efficiency_ratios": f"WITH {_MODELS} SELECT model, round(hit_at_10 / (ram_mb / 1024), 6) AS hit_per_gb, round(hit_at_10 / (latency_ms / 1000), 6) AS hit_per_s FROM m",
    "ablation": "WITH n AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1) SELECT o_orderpriority, size, count(*) AS runs, round(avg(o_totalprice), 4) AS mean_metric FROM orders JOIN n ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "recomputed_metrics": "SELECT strftime(ts, '%Y-%m-%d') AS day, day(any_value(ts)) % 7 <> 0 AND day(any_value(ts)) % 3 <> 0 AS agrees FROM events GROUP BY 1",
    "early_stops": """WITH b AS (SELECT user_id, ts, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
        r AS (SELECT *, sum(CASE WHEN value > best * 1.05::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bad FROM b)
        SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM r WHERE bad = 3 GROUP BY 1""",
    "best_checkpoints": "SELECT user_id, arg_min(event_id, (value, event_id)) AS event_id, min(value) AS value FROM events GROUP BY 1",
    "debug_case": f"WITH {_DOT} SELECT query_id, query_label, rank, vec_id, label FROM s WHERE query_id = (SELECT min(query_id) FROM q)",
}
QUERIES = {
    "retrieval_topk": retrieval_topk, "retrieval_metrics": retrieval_metrics, "retrieval_by_label": retrieval_by_label, "retrieval_failures": retrieval_failures, "metric_bands": metric_bands, "paired_ttest": paired_ttest, "compare_runs": compare_runs,
    "model_rejections": model_rejections, "recommend_model": recommend_model, "efficiency_ratios": efficiency_ratios, "ablation": ablation, "recomputed_metrics": recomputed_metrics, "early_stops": early_stops, "best_checkpoints": best_checkpoints, "debug_case": debug_case,
}
