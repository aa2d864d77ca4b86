"""What a run of a generator did: metadata, failures, attempts, the circuit breaker, latency and reliability."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_round

#: Categories of failures and the error classes that lead to them.
VALIDATION = ("malformed_json", "missing_field", "type_mismatch", "constraint_violation")
PROVIDER = ("timeout", "provider_unavailable", "model_error", "provider_or_model_error")
_BY_CLASS = {"MalformedJSONError": "malformed_json", "MissingFieldError": "missing_field", "TypeMismatchError": "type_mismatch", "ConstraintViolationError": "constraint_violation"}
_UNREACHABLE = ("OllamaUnavailableError", "UnavailableError")
_MODEL = ("ModelNotFoundError", "GenerationError", "RuntimeError")
MAX_ATTEMPTS = 3


def classify_failure(leaked: Column, attempts: Column, last_status: Column, first_error: Column) -> Column:
    """Category of a failed generation from its leak flag, number of attempts, last status and the last attempt's first error,
    which reads `Class: message`. A timeout counts in any case."""
    kind = F.regexp_extract(first_error, r"(?s)\A(\w+):", 1)
    out = F.when(leaked, "leakage").when(attempts == 0, "unknown").when(last_status == "success", "leakage").when(first_error.isNull(), "unknown")
    for name, category in _BY_CLASS.items():
        out = out.when(kind == name, category)
    late = F.contains(F.lower(first_error), F.lit("timed out"))
    out = out.when(kind.isin(*_UNREACHABLE) & late, "timeout").when(kind.isin(*_UNREACHABLE), "provider_unavailable")
    return out.when(kind.isin(*_MODEL), "model_error").otherwise("provider_or_model_error")


def run_metadata(records: DataFrame, total: DataFrame | int) -> DataFrame:
    """One row of counts and averages over all records; the success rate is over all input units, attempted or not."""
    ok, category, n = F.col("success"), F.col("failure_category"), F.col("attempt_count")
    one = records.agg(
        F.count("*").alias("attempted"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_attempts"),
        F.coalesce(py_round(F.sum(n) / F.count("*"), 3), F.lit(0.0)).alias("avg_attempts"),
        F.count_if(~ok & (category == "leakage")).alias("leakage_failures"),
        F.count_if(~ok & category.isin(*VALIDATION)).alias("validation_failures"),
        F.count_if(~ok & category.isin(*PROVIDER)).alias("provider_failures"),
        F.count_if(~ok & (n >= MAX_ATTEMPTS) & (category != "leakage")).alias("retry_exhausted"),
        F.coalesce(py_round(F.avg(F.when(ok, F.col("generation_ms"))), 1), F.lit(0.0)).alias("avg_generation_ms"),
    )
    if isinstance(total, int):
        units: Column = F.lit(total)
    else:
        one = one.crossJoin(F.broadcast(total.agg(F.count("*").alias("total_units"))))  # one row
        units = F.col("total_units")
    return one.withColumn("success_rate", F.when(units > 0, py_round(F.col("successful") / units, 4)).otherwise(0.0))


def run_document(records: DataFrame, total: DataFrame | int, settings: Mapping[str, object], seconds: float, style: str = "query_style") -> dict:
    """The metadata of a run as one document: counts and averages, the settings, failures by category, successes by style, wall time."""
    counts = run_metadata(records, total).first().asDict()
    failures = {r.failure_category or "unknown": r.n for r in breakdown(records.filter(~F.col("success")), "failure_category").orderBy("failure_category").limit(100).collect()}
    styles = {r[style]: r.n for r in breakdown(records.filter("success"), style).orderBy(style).limit(100).collect()}
    return counts | {"settings": dict(settings), "failure_breakdown": failures, "style_distribution": styles, "wall_clock_s": round(seconds, 3), "finished_utc": datetime.now(timezone.utc).isoformat()}


def legacy_metadata(records: DataFrame) -> DataFrame:
    """The counts of the older metadata. Its leak count is taken over the successes, so it is always 0, and is kept as that."""
    ok = F.col("success")
    return records.agg(F.count("*").alias("total_units"), F.count_if(ok).alias("total_queries"), F.count_if(~ok).alias("failed"), F.count_if(ok & (F.coalesce(F.col("failure_category"), F.lit("")) == "leakage")).alias("leakage_failures"))


def breakdown(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(column).agg(F.count("*").alias("n"))


def failure_cube(records: DataFrame, by: list[str]) -> DataFrame:
    """Failures by each prefix of `by`, down to the total."""
    return records.filter(~F.col("success")).rollup(*by).agg(F.count("*").alias("failures"))


def breaker_runs(records: DataFrame, run: str, order: list[str], failed: Column, limit: int = 3) -> DataFrame:
    """Unbroken series of provider failures within each run, in order of completion; `tripped` from `limit` on."""
    w = Window.partitionBy(run).orderBy(*order)
    r = records.withColumn("bad", F.coalesce(failed, F.lit(False)))
    r = r.withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = r.filter("bad").groupBy(run, "island").agg(F.count("*").alias("length"), F.min(F.struct(*order)).alias("first"))
    return g.select(run, *[F.col("first")[c].alias(c) for c in order], "length", (F.col("length") >= limit).alias("tripped"))


def attempt_sequence(attempts: DataFrame, unit: str, order: str, success: Column) -> DataFrame:
    """attempts with attempt_number, will_retry (another one follows) and first_success."""
    w = Window.partitionBy(unit).orderBy(order)
    good = F.coalesce(success, F.lit(False))
    before = F.max(good.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return attempts.select("*", F.row_number().over(w).cast("long").alias("attempt_number"), F.lead(F.lit(1)).over(w).isNotNull().alias("will_retry"), (good & (F.coalesce(before, F.lit(0)) == 0)).alias("first_success"))


def attempt_summary(attempts: DataFrame, unit: str, order: str, success: Column) -> DataFrame:
    """Per unit: attempts, the last one and the first successful one."""
    return attempts.groupBy(unit).agg(F.count("*").alias("attempts"), F.max(order).alias("last_attempt"), F.min(F.when(success, F.col(order))).alias("first_success"))


def latency(records: DataFrame, by: str, ms: str, exact: bool = True) -> DataFrame:
    """Least, greatest, median and mean. The exact median keeps a group's distinct values; without it, a sketch of fixed size."""
    median = F.percentile(ms, 0.5) if exact else F.percentile_approx(ms, 0.5, 10_000)
    return records.groupBy(by).agg(F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.round(median, 6).alias("median_ms"), F.round(F.avg(ms), 6).alias("mean_ms"))


def throughput(records: DataFrame, by: str, tokens: str, ms: str) -> DataFrame:
    """Tokens per second over all of a group's time; null without time."""
    return records.groupBy(by).agg(F.round(F.when(F.sum(ms) > 0, F.sum(tokens) / (F.sum(ms) / 1000)), 6).alias("tokens_per_s"))


def memory(records: DataFrame, by: str, rss: str) -> DataFrame:
    return records.groupBy(by).agg(F.max(rss).alias("peak"), F.min(rss).alias("least"), F.round(F.avg(rss), 6).alias("mean"))


def reliability(records: DataFrame, by: str) -> DataFrame:
    """Both readings of reliability, without retry and at all, and the share of valid attempts."""
    ok = F.col("success")
    return records.groupBy(by).agg(F.round(F.avg((ok & (F.col("attempt_count") == 1)).cast("double")), 6).alias("reliability_first"), F.round(F.avg(ok.cast("double")), 6).alias("reliability_any"), F.round(F.count_if(ok) / F.sum("attempt_count"), 6).alias("validity"))


def without_warmup(records: DataFrame, run: str, order: list[str], n: int = 5) -> DataFrame:
    """All but the first n records of each run."""
    return records.withColumn("__place", F.row_number().over(Window.partitionBy(run).orderBy(*order))).filter(F.col("__place") > n).drop("__place")


# ---------------------------------------------------------------- queries over the driver's tables


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as generation records."""
    category = F.element_at(F.array(*map(F.lit, ["leakage", "malformed_json", "timeout", "model_error", "missing_field"])), (F.col("user_id") % 5).cast("int") + 1)
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", "ts", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 3 + 1).alias("attempt_count"), F.col("value").alias("generation_ms"), F.when(F.col("event_type") == "error", category).alias("failure_category"))


def run_metadata_query(spark: SparkSession, d: str) -> DataFrame:
    return run_metadata(_events(spark, d), spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")).drop("total_units")


def failure_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return breakdown(_events(spark, d).filter("not success"), "failure_category")


def style_distribution(spark: SparkSession, d: str) -> DataFrame:
    return breakdown(_events(spark, d).filter("success"), "event_type")


def failure_rollup(spark: SparkSession, d: str) -> DataFrame:
    return failure_cube(_events(spark, d), ["failure_category", "day"])


def breaker(spark: SparkSession, d: str) -> DataFrame:
    return breaker_runs(_events(spark, d), "day", ["ts", "event_id"], ~F.col("success")).select("day", "event_id", "length", "tripped")


def attempt_history(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role")
    return attempt_sequence(c, "conv_id", "turn", F.col("role") == "assistant")


def attempt_summary_query(spark: SparkSession, d: str) -> DataFrame:
    return attempt_summary(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "assistant")


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return latency(_events(spark, d), "event_type", "generation_ms")


def throughput_query(spark: SparkSession, d: str) -> DataFrame:
    return throughput(_events(spark, d).withColumn("tokens", F.col("event_id") % 100 + 1), "event_type", "tokens", "generation_ms")


def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    return memory(_events(spark, d), "day", "generation_ms")


def reliability_query(spark: SparkSession, d: str) -> DataFrame:
    return reliability(_events(spark, d), "day")


def warmup_excluded(spark: SparkSession, d: str) -> DataFrame:
    return without_warmup(_events(spark, d), "day", ["ts", "event_id"]).groupBy("day").agg(F.count("*").alias("counted"), F.round(F.avg("generation_ms"), 6).alias("mean_ms"))


def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    """Error texts made from events, classified."""
    texts = ["MalformedJSONError: x", "MissingFieldError: a", "ConstraintViolationError: b", "UnavailableError: request Timed Out", "OllamaUnavailableError: refused", "ModelNotFoundError: m", "TimeoutError: timed out", None, "UnavailableError: no answer: refused", "OllamaUnavailableError: timed out", "TypeMismatchError: t", "GenerationError: timed out", "RuntimeError"]
    e = spark.read.parquet(f"{d}/events.parquet")
    error = F.element_at(F.array(*[F.lit(x).cast("string") for x in texts]), (F.col("event_id") % len(texts)).cast("int") + 1)
    return e.select("event_id", classify_failure(F.col("user_id") % 7 == 0, F.col("user_id") % 3, F.when(F.col("event_id") % 11 == 0, "success").otherwise("error"), error).alias("category"))


_E = "e AS (SELECT event_id, ts, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, event_type <> 'error' AS success, event_id % 3 + 1 AS attempt_count, value AS generation_ms, CASE WHEN event_type = 'error' THEN (['leakage', 'malformed_json', 'timeout', 'model_error', 'missing_field'])[user_id % 5 + 1] END AS failure_category FROM events)"
ORACLE = {
    "run_metadata": f"""WITH {_E} SELECT count(*) AS attempted, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, CAST(sum(attempt_count) AS BIGINT) AS total_attempts, round_even(sum(attempt_count) / count(*), 3) AS avg_attempts,
        count(*) FILTER (failure_category = 'leakage') AS leakage_failures, count(*) FILTER (failure_category IN ('malformed_json', 'missing_field')) AS validation_failures, count(*) FILTER (failure_category IN ('timeout', 'model_error')) AS provider_failures,
        count(*) FILTER (attempt_count >= 3 AND failure_category <> 'leakage') AS retry_exhausted, round_even(avg(generation_ms) FILTER (success), 1) AS avg_generation_ms, round_even(count(*) FILTER (success) / (SELECT count(*) FROM orders), 4) AS success_rate FROM e""",
    "failure_breakdown": f"WITH {_E} SELECT failure_category, count(*) AS n FROM e WHERE NOT success GROUP BY 1",
    "style_distribution": "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1",
    "failure_rollup": f"WITH {_E} SELECT failure_category, day, count(*) AS failures FROM e WHERE NOT success GROUP BY ROLLUP (failure_category, day)",
    "breaker_runs": f"WITH {_E}, i AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e) SELECT day, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS length, count(*) >= 3 AS tripped FROM i WHERE NOT success GROUP BY day, island",
    "attempt_history": "SELECT conv_id, turn, role, row_number() OVER w AS attempt_number, lead(1) OVER w IS NOT NULL AS will_retry, role = 'assistant' AND coalesce(max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS first_success FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "attempt_summary": "SELECT conv_id, count(*) AS attempts, max(turn) AS last_attempt, min(turn) FILTER (role = 'assistant') AS first_success FROM conversations GROUP BY 1",
    "latency_stats": "SELECT event_type, min(value) AS min_ms, max(value) AS max_ms, round(median(value), 6) AS median_ms, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1",
    "throughput": "SELECT event_type, round(sum(event_id % 100 + 1) / (sum(value) / 1000), 6) AS tokens_per_s FROM events GROUP BY 1",
    "memory_stats": f"WITH {_E} SELECT day, max(generation_ms) AS peak, min(generation_ms) AS least, round(avg(generation_ms), 6) AS mean FROM e GROUP BY 1",
    "reliability": f"WITH {_E} SELECT day, round(avg(CAST(success AND attempt_count = 1 AS DOUBLE)), 6) AS reliability_first, round(avg(CAST(success AS DOUBLE)), 6) AS reliability_any, round(count(*) FILTER (success) / sum(attempt_count), 6) AS validity FROM e GROUP BY 1",
    "warmup_excluded": f"WITH {_E}, p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS place FROM e) SELECT day, count(*) AS counted, round(avg(generation_ms), 6) AS mean_ms FROM p WHERE place > 5 GROUP BY 1",
    "failure_classes": """SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'leakage' WHEN user_id % 3 = 0 THEN 'unknown' WHEN event_id % 11 = 0 THEN 'leakage' ELSE (['malformed_json', 'missing_field', 'constraint_violation', 'timeout', 'provider_unavailable', 'model_error', 'provider_or_model_error', 'unknown', 'provider_unavailable', 'timeout', 'type_mismatch', 'model_error', 'provider_or_model_error'])[event_id % 13 + 1] END AS category FROM events""",
}
QUERIES = {
    "run_metadata": run_metadata_query, "failure_breakdown": failure_breakdown, "style_distribution": style_distribution, "failure_rollup": failure_rollup, "breaker_runs": breaker, "attempt_history": attempt_history, "attempt_summary": attempt_summary_query,
    "latency_stats": latency_stats, "throughput": throughput_query, "memory_stats": memory_stats, "reliability": reliability_query, "warmup_excluded": warmup_excluded, "failure_classes": failure_classes,
}
