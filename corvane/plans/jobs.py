"""Whole jobs: building a dataset, generating queries, repairing and merging artifacts. Exit codes are the callers' contract."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.structured import with_canonical
from ..operators import dataset, generate, recovery, runs
from ..schemas import AUDIT, METHOD, PAYLOAD
from ..sources import artifacts, code, sinks, system
from ..streaming.checkpoint import Breaker, Locked, RecordStore, RunLock, failing_runs, pace

OK, ERROR, CONFLICTS, UNREACHABLE, BROKEN, LOCKED = 0, 1, 2, 2, 3, 4


def build_dataset(spark: SparkSession, roots: list[dict], out: str, extracted_at: str | None = None) -> DataFrame:
    """Extract units of all repositories, keep the first of each content, assign splits and write them.

    roots: dicts of id, path, base_url and split, in manifest order, which decides what is first. Returns one row of counts.
    """
    every = None
    for place, r in enumerate(roots):
        files = code.parsed(code.python_files(spark, r["path"], r["id"]))
        u = code.units_of(files, r.get("base_url", ""), extracted_at).withColumn("place", F.lit(place))
        every = u if every is None else every.unionByName(u)
    if every is None:
        raise ValueError("no repositories")
    order = F.struct("place", dataset.path_order(F.col("file_path")), "position")
    columns = [c for c in every.columns if c not in ("place", "position")]
    kept = dataset.first_of_each(every, F.col("content_hash"), order, columns).drop("dedup_key")
    manifest = spark.createDataFrame([(r["id"], r["split"]) for r in roots], "repository string, split string")
    units = dataset.assign_splits(kept, manifest)
    sinks.write_dataset(units.drop("copies"), out)
    totals = units.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("extracted"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("total"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")])
    checked = dataset.count_consistency(totals)
    counts = checked.first().asDict()
    by = {f"by_{c}": {r[c]: r["count"] for r in units.groupBy(c).count().orderBy(c).limit(10_000).collect()} for c in ("repository", "split", "symbol_type", "language")}
    sinks.replace_json(spark, f"{out}/meta/stats.json", counts | {"code_units": {"total": counts["total"], **by}})
    sinks.write_version(spark, out, counts, roots, system.manifest_hash([{k: r.get(k) for k in ("id", "split", "base_url", "commit")} for r in roots]))
    return checked


def generate_queries(
    spark: SparkSession, units: DataFrame, out: str, factory: generate.Factory, settings: generate.Settings = generate.Settings(), reachable: Callable[[], bool] = lambda: True, fresh: bool = False, limit: int | None = None,
    workers: int | None = None, batch_units: int = 100, order: tuple[str, ...] = ("id",), breaker: int = 3, told: Callable[[dict], None] = lambda _: None,
    dataset_path: str | None = None,
) -> int:
    """Records for all units that have none yet, in batches of bounded size, under the folder's lock. Returns an exit code.

    order: columns that say which units are first for `limit`, such as `place` of artifacts.file_order(). After `breaker` provider failures
    in a row, in order of completion and over all batches, no further batch is asked; within a batch a task gives up after as
    many of its own. told: gets the pace after each batch. dataset_path: of the dataset whose metadata say what queries are made with.
    """
    store = RecordStore(spark, out)
    try:
        with RunLock(spark, out):
            if fresh:
                store.clear()
            if units.isEmpty():
                return ERROR
            if not reachable():
                return UNREACHABLE
            todo = store.pending(units)
            if limit is not None:
                todo = todo.orderBy(*order).limit(limit)
            # told apart once: neither the units nor the store are read again with each batch
            queue = f"{out.rstrip('/')}/queue"
            total = todo.count()
            parts = max(1, -(-total // batch_units))
            todo.withColumn("queue_part", F.pmod(F.xxhash64("id"), F.lit(parts))).repartition("queue_part").write.mode("overwrite").partitionBy("queue_part").parquet(queue)
            code_, failing, done, start = OK, 0, 0, time.monotonic()
            for part in range(parts) if total else ():
                own = spark.read.parquet(queue).filter(F.col("queue_part") == part).drop("queue_part")
                asked = prompts.blind(own)
                prompts.assert_blind(asked)
                made = generate.generate(asked.select("id", prompts.query_prompt().alias("prompt")), factory, workers=workers, give_up=breaker)
                number = store.append(generate.audit_records(made, own, settings), checked=True)
                written = spark.read.schema(AUDIT).parquet(f"{out.rstrip('/')}/records/batch={number:09d}")
                done += written.count()
                told(pace(done, total, time.monotonic() - start))
                longest, failing = failing_runs(written, failing)
                if longest >= breaker:
                    code_ = BROKEN
                    break
            s = settings.__dict__
            if dataset_path:
                block = {"model_name": s["model"], "model_version": s["model_version"], "prompt_template_version": s["prompt_version"], "seed": s["seed"], "generation_params": {"temperature": s["temperature"], "top_p": s["top_p"]}}
                sinks.update_query_generation(spark, dataset_path, block)
            sinks.replace_json(spark, f"{out}/metadata.json", runs.run_document(store.read(), units, settings.__dict__, time.monotonic() - start))
            return code_
    except Locked:
        return LOCKED
    except Breaker:
        return BROKEN


_ORDER = {"unit": "code_unit_id", "time": "completed_utc", "order": ["canonical", "place"]}


def _numbered(df: DataFrame, start: int) -> DataFrame:
    """Rows told apart even if they are the same text; which of equal rows stands makes no difference."""
    w = Window.partitionBy("raw").orderBy(F.lit(0))
    return df.withColumn("place", F.row_number().over(w) * 2 + start)


def _ranked(a: DataFrame, b: DataFrame) -> DataFrame:
    """Successes and failures in one table with what orders them: time, then the JSON with sorted keys."""
    r = recovery.tagged(_numbered(a, 0), _numbered(b, 1)).withColumn("completed_utc", F.coalesce("completed_utc", F.lit("")))
    return with_canonical(r, "raw")


def _plan(records: DataFrame) -> DataFrame:
    return recovery.verdicts(records, "code_unit_id", "completed_utc", ["canonical", "place"], list(PAYLOAD), list(METHOD), "candidate_id")


def recover(spark: SparkSession, successes: str, failures: str, out: str, isolate: bool = False, dry_run: bool = False) -> int:
    """Repair two JSON-lines artifacts into a new version below `out`; units in conflict are refused, or set aside with `isolate`."""
    try:
        a, b = (artifacts.strict_records(spark, path, AUDIT, keep_raw=True) for path in (successes, failures))
    except artifacts.BrokenArtifact:
        return ERROR
    r = _ranked(a, b)
    plan = _plan(r).cache()
    try:
        bad = plan.filter(F.col("verdict").isin(*recovery.KINDS))
        n = bad.count()
        if n and not isolate:
            return CONFLICTS
        if dry_run:
            return OK
        live = recovery.standing(r, plan, **_ORDER)
        tables = {"successes": sinks.sorted_lines(live.filter("success"), "code_unit_id"), "failures": sinks.sorted_lines(live.filter("not success"), "code_unit_id")}
        if n:
            tables["quarantined"] = recovery.conflict_report(r, plan, "code_unit_id").orderBy("kind", "code_unit_id", "completed_utc", "raw").select(F.col("raw").alias("value"))
            # a line for each record in conflict, with its kind: the report proper, of any size
            report = recovery.conflict_report(r, plan, "code_unit_id").orderBy("kind", "code_unit_id", "completed_utc", "raw")
            tables["conflicts"] = report.select(F.to_json(F.struct("kind", "code_unit_id", "success", "completed_utc", F.col("raw").alias("record"))).alias("value"))
        versions = sinks.Versions(spark, out)
        versions.publish(tables, "lines")
        if n:
            sinks.replace_json(spark, f"{versions.current()}/conflicts.json", {"kinds": {x.verdict: x["count"] for x in bad.groupBy("verdict").count().collect()}, "units": n})
        return OK
    finally:
        plan.unpersist()


def merge(spark: SparkSession, store: tuple[str, str], staged: tuple[str, str], out: str, dry_run: bool = False, one_method: bool = True) -> int:
    """Add regenerated records to a repaired store.

    Nothing is done if the staged records, whatever the order of their keys, are there already. Units that both have, and
    units that are in conflict over both, are an error; with `one_method`, so are successes that weren't all made in one way.
    """
    try:
        old, new = (_ranked(*artifacts.load_store(spark, *x, AUDIT, keep_raw=True)) for x in (store, staged))
    except artifacts.BrokenArtifact:
        return ERROR
    if recovery.already_merged(new.select("canonical"), old.select("canonical")).isEmpty():
        return OK
    if not recovery.key_overlap(old, new, "code_unit_id").isEmpty():
        return ERROR
    both = old.unionByName(new)
    if not _plan(both).filter(F.col("verdict").isin(*recovery.KINDS)).isEmpty():
        return ERROR
    if one_method and recovery.signatures(both.filter("success"), list(METHOD)).first()[0] > 1:
        return ERROR
    if not dry_run:
        sinks.Versions(spark, out).publish({"successes": sinks.sorted_lines(both.filter("success"), "code_unit_id"), "failures": sinks.sorted_lines(both.filter("not success"), "code_unit_id")}, "lines")
    return OK


def build_subset(spark: SparkSession, split: str, ids: DataFrame, out: str) -> int:
    """Copy the lines of units in conflict, byte for byte, as the input of a new generation."""
    try:
        lines = artifacts.verbatim_subset(spark, split, ids, F.get_json_object("value", "$.id"))
    except artifacts.BrokenArtifact:
        return ERROR
    lines.write.mode("overwrite").text(out)
    return OK
