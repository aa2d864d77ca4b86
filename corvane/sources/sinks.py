"""Writing datasets, reports and exports."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import _hadoop


class RepeatedKey(ValueError):
    """A key that must be unique isn't."""


def bumped(version: str, change: str) -> str:
    """The next version: major for another schema, minor for other content, patch for a repair."""
    parts = [int(x) for x in version.split(".")]
    if len(parts) != 3 or change not in ("major", "minor", "patch"):
        raise ValueError(f"{version} {change}")
    at = ("major", "minor", "patch").index(change)
    return ".".join(str(x + 1 if k == at else x if k < at else 0) for k, x in enumerate(parts))


def write_version(spark: SparkSession, path: str, counts: dict, repositories: list[dict], manifest_hash: str, change: str | None = None, **more: object) -> dict:
    """meta/version.json of a dataset: its version, where it comes from and how many units it has. With `change`, the version that is there is
    bumped and what queries were made with is kept."""
    before = json.loads(read_text(spark, f"{path}/meta/version.json") or "null")
    now = {
        "version": bumped(before["version"], change) if before and change else "1.0.0",
        "schema_version": "1.0.0",
        "release_date": datetime.now(timezone.utc).strftime("%Y-%m-%d"),
        "repositories": sorted(r["id"] for r in repositories),
        "repository_commits": {r["id"]: r.get("commit") for r in repositories},
        "repository_splits": {r["id"]: r["split"] for r in repositories},
        "manifest_hash": manifest_hash,
        "total_code_units": counts["total"],
        "extracted_code_units": counts["extracted"],
        "duplicate_code_units": counts["duplicates"],
        **{f"{s}_cases": counts[s] for s in ("train", "validation", "test")},
        "total_queries": 0,
        "parser": "python_ast",
        "deduplication_method": "sha256_of_stripped_source_utf8",
        "eligibility_rules": {"min_source_lines": 3, "max_source_lines": 100},
        "frozen": False,
    } | more
    if before and change and "query_generation" in before:
        now["query_generation"] = before["query_generation"]
    replace_json(spark, f"{path}/meta/version.json", now)
    return now


def update_query_generation(spark: SparkSession, path: str, block: dict) -> dict:
    """Put what queries are made with into meta/version.json and leave everything else as it is."""
    text = read_text(spark, f"{path}/meta/version.json")
    if text is None:
        raise FileNotFoundError(f"{path}/meta/version.json")
    meta = json.loads(text) | {"query_generation": block}
    replace_json(spark, f"{path}/meta/version.json", meta)
    return meta


def write_candidates(spark: SparkSession, records: DataFrame, path: str) -> dict:
    """The older artifact: all successful records at once, in place of what was there, and the number of queries in meta/version.json."""
    from ..operators.runs import legacy_metadata

    records.filter("success").write.mode("overwrite").json(f"{path}/queries/candidates")
    counts = legacy_metadata(records).first().asDict()
    text = read_text(spark, f"{path}/meta/version.json")
    if text is not None:
        replace_json(spark, f"{path}/meta/version.json", json.loads(text) | {"total_queries": counts["total_queries"]})
    return counts


def write_dataset(units: DataFrame, path: str, fmt: str = "json") -> None:
    """Units by repository, and once more by split, for readers that prune by either."""
    units.write.mode("overwrite").partitionBy("repository").format(fmt).save(f"{path}/by_repository")
    units.write.mode("overwrite").partitionBy("split").format(fmt).save(f"{path}/splits")


def sorted_lines(df: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """One text line per row in the order of a key that must be unique; the lines are the rows' raw text."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").orderBy(key).limit(5).collect()
    if twice:
        raise RepeatedKey(", ".join(str(r[0]) for r in twice))
    return df.orderBy(key).select(F.col(raw).alias("value"))


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place in one step: written aside, then renamed."""
    p, fs = _hadoop(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(draft, p, options)


def replace_json(spark: SparkSession, path: str, value: object) -> None:
    replace_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True) + "\n")


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Versions:
    """A folder of versions with a pointer to the current one. Several tables change together when the pointer does."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> str | None:
        text = read_text(self.spark, f"{self.path}/CURRENT")
        return f"{self.path}/{text.strip()}" if text else None

    def publish(self, tables: dict[str, DataFrame], fmt: str = "parquet") -> str:
        """Write all tables below a new folder, then point to it; the version before stays as the backup."""
        name = f"v-{uuid.uuid4().hex}"
        for key, df in tables.items():
            if fmt == "lines":
                df.write.text(f"{self.path}/{name}/{key}")  # sorted rows come in files in order of their names
            else:
                df.write.format(fmt).save(f"{self.path}/{name}/{key}")
        replace_text(self.spark, f"{self.path}/CURRENT", name)
        return f"{self.path}/{name}"


def export(df: DataFrame, path: str, fmt: str, limit: int = 10_000) -> None:
    """csv, json or md; a Markdown table is a report for people, so more rows than `limit` are refused."""
    if fmt == "md":
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"a Markdown report of more than {limit} rows")
        cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
        lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
        replace_text(df.sparkSession, path, "\n".join(lines) + "\n")
    elif fmt in ("csv", "json"):
        (df.write.mode("overwrite").option("header", True) if fmt == "csv" else df.write.mode("overwrite")).format(fmt).save(path)
    else:
        raise ValueError(f"no such format: {fmt}")


def write_run(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Artifacts of a benchmark run, one folder per table, by run."""
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(f"{path}/{name}")
