"""Repairing artifacts of overlapping runs: which record of a unit stands, which are superseded, which units are in conflict.

A record has a unit, an outcome, an order (completion time, then the record's text, then its place) and two signatures.
The first rule that applies decides:

1. candidate_id_mismatch: a record's candidate id isn't the one of its unit;
2. semantic_candidate_conflict: successes differ in what they say;
3. methodology_mismatch: successes differ in how they were made;
4. without a success the latest failure stands;
5. failure_supersedes_success: the latest failure is later than the latest success (a tie is none);
6. the earliest success stands, and all other records are superseded.

Verdicts come from one aggregate per unit whose parts combine on the map side; equal signatures are seen by least = greatest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import group_stats

#: Kinds of conflicts.
KINDS = ("candidate_id_mismatch", "semantic_candidate_conflict", "methodology_mismatch", "failure_supersedes_success")


def tagged(successes: DataFrame, failures: DataFrame, flag: str = "success") -> DataFrame:
    """Both artifacts in one table with the outcome as a column."""
    return successes.withColumn(flag, F.lit(True)).unionByName(failures.withColumn(flag, F.lit(False)), allowMissingColumns=True)


def cross_file_overview(records: DataFrame, unit: str, time: str, flag: str = "success") -> DataFrame:
    """Units only in one artifact or in both, and for the latter which outcome is later. A tie counts as the failure's."""
    g = records.groupBy(unit).agg(F.max(F.when(F.col(flag), F.col(time))).alias("s"), F.max(F.when(~F.col(flag), F.col(time))).alias("f"))
    both = F.col("s").isNotNull() & F.col("f").isNotNull()
    return g.agg(
        F.count_if(F.col("f").isNull()).alias("successes_only"),
        F.count_if(F.col("s").isNull()).alias("failures_only"),
        F.count_if(both).alias("in_both"),
        F.count_if(both & (F.col("s") > F.col("f"))).alias("success_is_later"),
        F.count_if(both & (F.col("s") <= F.col("f"))).alias("failure_is_later"),
    )


def verdicts(records: DataFrame, unit: str, time: str, order: list[str], payload: list[str], method: list[str], candidate: str, flag: str = "success") -> DataFrame:
    """One row per unit: (unit, verdict, record). verdict is a kind of conflict, `canonical` or `failure_only`; record is the
    standing record's order struct, null for conflicts. order ends with a unique column; it follows the time."""
    ok = F.col(flag)
    key = F.struct(time, *order)
    said, made = F.struct(*payload), F.struct(*method) if method else F.lit(1)
    g = records.groupBy(unit).agg(
        F.count_if(~F.col(candidate).eqNullSafe(F.concat(F.lit("candidate_"), F.col(unit).cast("string")))).alias("bad_ids"),
        F.min(F.when(ok, said)).alias("said_min"), F.max(F.when(ok, said)).alias("said_max"),
        F.min(F.when(ok, made)).alias("made_min"), F.max(F.when(ok, made)).alias("made_max"),
        F.max(F.when(ok, F.col(time))).alias("last_success"), F.max(F.when(~ok, F.col(time))).alias("last_failure"),
        F.min(F.when(ok, key)).alias("success"), F.max(F.when(~ok, key)).alias("failure"),
    )
    verdict = (
        F.when(F.col("bad_ids") > 0, KINDS[0])
        .when(~F.col("said_min").eqNullSafe(F.col("said_max")), KINDS[1])
        .when(~F.col("made_min").eqNullSafe(F.col("made_max")), KINDS[2])
        .when(F.col("success").isNull(), "failure_only")
        .when(F.col("last_failure") > F.col("last_success"), KINDS[3])
        .otherwise("canonical")
    )
    g = g.withColumn("verdict", verdict)
    return g.select(unit, "verdict", F.when(F.col("verdict") == "canonical", F.col("success")).when(F.col("verdict") == "failure_only", F.col("failure")).alias("record"))


def superseded(records: DataFrame, plan: DataFrame, unit: str, time: str, order: list[str]) -> DataFrame:
    """Records of units without conflict that don't stand."""
    live = plan.filter(F.col("record").isNotNull()).select(unit, "record")
    return records.join(live, unit).filter(F.struct(time, *order) != F.col("record")).drop("record")


def standing(records: DataFrame, plan: DataFrame, unit: str, time: str, order: list[str]) -> DataFrame:
    """Records that stand: canonical successes and latest failures."""
    return records.join(plan.filter(F.col("record").isNotNull()).select(unit, "record"), unit).filter(F.struct(time, *order) == F.col("record")).drop("record")


def conflict_report(records: DataFrame, plan: DataFrame, unit: str) -> DataFrame:
    """Original records of units in conflict with the kind, to be sorted by kind and unit."""
    return records.join(plan.filter(F.col("verdict").isin(*KINDS)).select(unit, F.col("verdict").alias("kind")), unit)


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both have."""
    return a.select(key).intersect(b.select(key))


def already_merged(staged: DataFrame, merged: DataFrame) -> DataFrame:
    """Staged rows that the merged table doesn't hold as they are; none if the merge was done before."""
    return staged.join(merged, [staged[c].eqNullSafe(merged[c]) for c in staged.columns], "left_anti")


def signatures(records: DataFrame, columns: list[str]) -> DataFrame:
    """Number of distinct signatures; a missing value counts as a value."""
    return records.agg(F.count_distinct(F.struct(*columns)).alias("signatures"))


# ---------------------------------------------------------------- queries over the driver's tables

_PLAN = {"unit": "unit", "time": "ts", "order": ["event_id"]}


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Events as outcomes: a unit is a user's day, an error a failure, any other type the payload of a success."""
    e = spark.read.parquet(f"{d}/events.parquet")
    unit = F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", "ts", "event_type", unit.alias("unit"), F.concat(F.lit("candidate_"), unit).alias("candidate_id"), (F.col("event_type") != "error").alias("success"))


def _plan(r: DataFrame) -> DataFrame:
    return verdicts(r, "unit", "ts", ["event_id"], ["event_type"], [], "candidate_id")


def recovery_stats(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    a = group_stats(r.filter("success"), "unit").withColumn("artifact", F.lit("successes"))
    return a.unionByName(group_stats(r.filter("not success"), "unit").withColumn("artifact", F.lit("failures")))


def recovery_overview(spark: SparkSession, d: str) -> DataFrame:
    return cross_file_overview(_records(spark, d), "unit", "ts")


def recovery_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(_records(spark, d)).select("unit", "verdict", F.col("record.event_id").alias("event_id"))


def recovery_superseded(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return superseded(r, _plan(r), **_PLAN).select("event_id", "unit", "success")


def conflict_report_query(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return conflict_report(r, _plan(r), "unit").select("kind", "unit", "event_id", "success").orderBy("kind", "unit", "event_id")


def recovery_counts(spark: SparkSession, d: str) -> DataFrame:
    return _plan(_records(spark, d)).groupBy("verdict").agg(F.count("*").alias("units"))


def disjoint_audit(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise overlaps of customers by the status of their orders."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderstatus").distinct()
    per = o.groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("s"))  # a handful of statuses
    pairs = F.filter(F.flatten(F.transform("s", lambda a: F.transform("s", lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda p: p["a"] < p["b"])
    return per.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("status_a"), F.col("p.b").alias("status_b")).agg(F.count("*").alias("customers"))


def already_merged_query(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one priority staged against all orders of finished status: those still to be merged."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return already_merged(o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_orderstatus = 'F'").withColumnsRenamed({})).select("o_orderkey", "o_orderstatus")


def signature_count(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return signatures(e.select("event_type", F.when(F.col("event_id") % 3 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("day")), ["event_type", "day"])


_R = "r AS (SELECT event_id, ts, event_type, user_id || '|' || strftime(ts, '%Y-%m-%d') AS unit, event_type <> 'error' AS success FROM events)"
_P = f"""WITH {_R}, g AS (SELECT unit, count(DISTINCT event_type) FILTER (success) AS payloads, max(ts) FILTER (success) AS s, max(ts) FILTER (NOT success) AS f,
    arg_min(event_id, (ts, event_id)) FILTER (success) AS good, arg_max(event_id, (ts, event_id)) FILTER (NOT success) AS bad FROM r GROUP BY unit),
    p AS (SELECT unit, CASE WHEN payloads > 1 THEN 'semantic_candidate_conflict' WHEN good IS NULL THEN 'failure_only' WHEN f > s THEN 'failure_supersedes_success' ELSE 'canonical' END AS verdict, good, bad FROM g),
    v AS (SELECT unit, verdict, CASE verdict WHEN 'canonical' THEN good WHEN 'failure_only' THEN bad END AS event_id FROM p)"""
_STATS = "SELECT '{0}' AS artifact, CAST(sum(n) AS BIGINT) AS records, count(*) AS unique_ids, count(*) FILTER (n > 1) AS duplicate_groups, coalesce(max(n) FILTER (n > 1), 0) AS max_multiplicity, CAST(sum(n - 1) AS BIGINT) AS extra_records FROM (SELECT count(*) AS n FROM r WHERE {1} GROUP BY unit)"
ORACLE = {
    "recovery_stats": f"WITH {_R} {_STATS.format('successes', 'success')} UNION ALL {_STATS.format('failures', 'NOT success')}",
    "recovery_overview": f"WITH {_R}, g AS (SELECT unit, max(ts) FILTER (success) AS s, max(ts) FILTER (NOT success) AS f FROM r GROUP BY unit) SELECT count(*) FILTER (f IS NULL) AS successes_only, count(*) FILTER (s IS NULL) AS failures_only, count(*) FILTER (s IS NOT NULL AND f IS NOT NULL) AS in_both, count(*) FILTER (s > f) AS success_is_later, count(*) FILTER (s <= f) AS failure_is_later FROM g",
    "recovery_plan": f"{_P} SELECT * FROM v",
    "recovery_counts": f"{_P} SELECT verdict, count(*) AS units FROM v GROUP BY 1",
    "recovery_superseded": f"{_P} SELECT r.event_id, r.unit, r.success FROM r JOIN v ON r.unit = v.unit WHERE v.event_id IS NOT NULL AND r.event_id <> v.event_id",
    "conflict_report": f"{_P} SELECT verdict AS kind, r.unit, r.event_id, r.success FROM r JOIN v ON r.unit = v.unit WHERE v.event_id IS NULL",
    "disjoint_audit": "WITH o AS (SELECT DISTINCT o_custkey AS c, o_orderstatus AS s FROM orders) SELECT a.s AS status_a, b.s AS status_b, count(*) AS customers FROM o a JOIN o b ON a.c = b.c AND a.s < b.s GROUP BY ALL",
    "already_merged": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'",
    "signature_count": "SELECT count(*) AS signatures FROM (SELECT DISTINCT event_type, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d') END FROM events)",
}
QUERIES = {
    "recovery_stats": recovery_stats, "recovery_overview": recovery_overview, "recovery_plan": recovery_plan, "recovery_counts": recovery_counts, "recovery_superseded": recovery_superseded, "conflict_report": conflict_report_query,
    "disjoint_audit": disjoint_audit, "already_merged": already_merged_query, "signature_count": signature_count,
}
