"""A benchmark run from the frozen workload to stored metrics, and what is asked of stored runs.

A workload is a folder with units.jsonl, queries.jsonl, qrels.jsonl and workload.json (name, version). A run is a folder below the output
folder: raw answers, the index, results, first ranks, and one JSON document of metrics. Everything that grows with the workload
stays in tables.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import prompts
from ..functions.structured import LABEL
from ..functions.text import word_count
from ..operators import dataset, evaluate, generate, runs
from ..schemas import PERSISTED_UNIT, QREL, QUERY_CASE
from ..sources import artifacts, sinks, system

VERSION = "1.0.0"
#: Dimensions of the fixed embedding.
DIMENSIONS = 512


class WorkloadError(ValueError):
    """A workload that can't be run."""


@dataclass(frozen=True)
class Workload:
    name: str
    version: str
    units: DataFrame
    queries: DataFrame
    qrels: DataFrame
    digest: str


def workloads(spark: SparkSession, root: str) -> list[dict]:
    """Name, version and path of the workloads below a folder, by name."""
    p, fs = artifacts._hadoop(spark, root)
    found = []
    for x in fs.listStatus(p) if fs.exists(p) else []:
        text = sinks.read_text(spark, f"{x.getPath()}/workload.json") if x.isDirectory() else None
        if text:
            found.append(json.loads(text) | {"path": str(x.getPath())})
    return sorted(found, key=lambda w: w["name"])


def load(spark: SparkSession, path: str) -> Workload:
    """The workload and the digest that it is frozen by: the lines of all files in any order."""
    text = sinks.read_text(spark, f"{path}/workload.json")
    if text is None:
        raise WorkloadError(f"no workload at {path}")
    said = json.loads(text)
    tables, parts = {}, []
    for name, schema in (("units", PERSISTED_UNIT), ("queries", QUERY_CASE), ("qrels", QREL)):
        lines = artifacts.raw_lines(spark, f"{path}/{name}.jsonl").select("value")
        tables[name] = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
        one = lines.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("value")), F.lit(0)).alias("x")).first()
        parts.append(f"{name}:{one.n}:{one.x & (2**64 - 1):016x}")
    return Workload(said["name"], said["version"], **tables, digest=",".join(parts))


def checks(w: Workload, least_train: int = 201, least_test: int = 51, coverage: float = 0.8, split: str = "test") -> DataFrame:
    """(check, violations) of a workload: ids, references, splits, scores and the sizes that make results worth anything."""
    u, q, r = w.units, w.queries, w.qrels
    relevant = r.filter(F.col("relevance_score") > 0.5).select("query_id").distinct()
    short = lambda name, least: u.agg(F.count_if(F.col("split") == name).alias("n")).filter(F.col("n") < least)
    low = q.join(relevant, F.col("id") == F.col("query_id"), "left").agg(F.count("*").alias("n"), F.count("query_id").alias("k")).filter((F.col("n") == 0) | (F.col("k") / F.col("n") <= coverage))
    return dataset.validate(
        {
            "repeated unit": u.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"),
            "repeated query": q.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"),
            "unit without text": u.filter(F.coalesce("source_code", F.lit("")) == ""),
            "relevance without unit": dataset.missing_references(r, F.col("code_unit_id"), u, "id"),
            "relevance without query": dataset.missing_references(r, F.col("query_id"), q, "id"),
            "query without relevant unit": q.filter(~F.coalesce(dataset.query_gate(F.col("relevant_code_units")), F.lit(False))),
            "score out of range": r.filter(~F.coalesce(dataset.relevance_gate(F.col("relevance_score")), F.lit(False))),
            "query outside of the test split": q.filter(F.col("split") != split),
            "repository in two splits": dataset.shared_repositories(u),
            "train split too small": short("train", least_train),
            "test split too small": short(split, least_test),
            "low relevance coverage": low,
        },
        u.sparkSession,
    )


def embed(texts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, vec_id, embedding): words hashed into DIMENSIONS counts of length 1. The fixed baseline of all runs, in built-in functions."""
    words = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda x: x != "")
    spots = F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(DIMENSIONS)).cast("int"))
    rows = texts.select(F.col(id_col).alias("id"), F.explode_outer(spots).alias("spot")).groupBy("id", "spot").agg(F.count("*").cast("double").alias("n"))
    maps = rows.filter("spot is not null").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("spot", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))  # DIMENSIONS entries at most
    vector = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("size"))
    return maps.select("id", F.xxhash64("id").alias("vec_id"), vector.alias("embedding"))


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, code_unit_id, rank) of the k nearest artifacts of each query."""
    asked = queries.withColumn("vec_id", F.xxhash64(F.concat(F.lit("query:"), F.col("id"))))
    found = evaluate.top_k(index, asked, k)
    found = found.join(index.select("vec_id", F.col("id").alias("code_unit_id")), "vec_id")
    return found.join(asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("query")), "query_id").select(F.col("query").alias("query_id"), "code_unit_id", "rank")


def run(spark: SparkSession, workload: str, models: Mapping[str, generate.Factory], out: str, config: Config = Config(), split: str = "test", run_id: str | None = None, verify: Mapping[str, int | float] | None = None) -> str:
    """Run all models over a workload and store everything; returns the folder of the run.

    Freeze, check, profile, warm up with the first cases (their answers are dropped), generate, index, search, measure. Each repetition
    is a pass of its own; latencies are over all passes, retrieval goes by the first.
    """
    w = load(spark, workload)
    wrong = checks(w, split=split, **(verify or {})).filter("violations > 0").collect()
    if wrong:
        raise WorkloadError("; ".join(f"{r.check}: {r.violations}" for r in wrong))
    started = datetime.now(timezone.utc)
    folder = f"{out.rstrip('/')}/{run_id or started.strftime('run-%Y%m%d-%H%M%S')}"
    profile = {k: v for k, v in system.system_profile(spark).first().asDict().items()}
    cases = w.units.filter(F.col("split") == split)
    asked = prompts.blind(cases)
    prompts.assert_blind(asked)
    asked = asked.select("id", prompts.label_prompt().alias("prompt"))
    retry = generate.Retry(config.retry_max_attempts)
    queries = embed(w.queries, "id", F.col("query"))
    document = {"benchmark_version": VERSION, "workload": w.name, "workload_version": w.version, "frozen": w.digest, "timestamp": started.isoformat(), "hardware": profile, "config": asdict(config), "models": {}}
    for name, factory in models.items():
        place = f"{folder}/model={name}"
        if config.warmup_cases:
            generate.generate(asked.orderBy("id").limit(config.warmup_cases), factory, LABEL, retry).write.format("noop").mode("overwrite").save()
        for repetition in range(config.repetitions):
            # written before anything is measured: what a model said isn't asked again
            generate.generate(asked, factory, LABEL, retry).withColumn("repetition", F.lit(repetition)).write.mode("append").parquet(f"{place}/raw")
        raw = spark.read.parquet(f"{place}/raw")
        labels = generate.semantic_labels(raw.filter("repetition = 0"))
        text = F.concat_ws(" ", "summary", "description", F.array_join("concepts", " "))
        embed(labels, "code_unit_id", text).write.parquet(f"{place}/index")
        search(spark.read.parquet(f"{place}/index"), queries).write.parquet(f"{place}/results")
        ranks = first_ranks(spark.read.parquet(f"{place}/results"), w)
        ranks.write.parquet(f"{place}/ranks")
        document["models"][name] = measure(raw, spark.read.parquet(f"{place}/ranks"))
    sinks.replace_json(spark, f"{folder}/metrics.json", document)
    sinks.replace_text(spark, f"{folder}/report.md", report(document))
    return folder


def first_ranks(results: DataFrame, w: Workload) -> DataFrame:
    """(query_id, first_rank) of the first relevant artifact of each query."""
    relevant = w.qrels.filter(F.col("relevance_score") > 0).select("query_id", "code_unit_id").distinct().withColumn("hit", F.lit(True))
    found = results.join(relevant, ["query_id", "code_unit_id"], "left")
    return evaluate.first_ranks(found, F.coalesce("hit", F.lit(False)), w.queries.select(F.col("id").alias("query_id")))


def measure(raw: DataFrame, ranks: DataFrame) -> dict:
    """All metrics of one model as a document of fixed size. Tokens that no server counted are estimated as 4/3 of the words."""
    last = F.try_element_at("attempts", F.lit(-1))
    r = raw.select(F.lit("all").alias("all"), "success", F.size("attempts").alias("attempt_count"), "generation_ms", F.when(F.col("success"), F.ceil(word_count(last["raw_text"]) * 4 / 3)).otherwise(0).alias("tokens"))
    ok = r.filter("success")
    out = evaluate.hit_and_mrr(ranks).first().asDict()
    out |= runs.latency(ok, "all", "generation_ms", exact=False).drop("all").first().asDict() if not ok.isEmpty() else {}
    out |= runs.throughput(ok, "all", "tokens", "generation_ms").drop("all").first().asDict() if not ok.isEmpty() else {}
    out |= runs.reliability(r, "all").drop("all").first().asDict()
    return out | {"cases": raw.filter("repetition = 0").count(), "failures": raw.filter("not success and repetition = 0").count(), "peak_mb": round(_peak_mb(), 1)}


def _peak_mb() -> float:
    import resource

    return max(resource.getrusage(x).ru_maxrss for x in (resource.RUSAGE_SELF, resource.RUSAGE_CHILDREN)) / 1024


def report(document: Mapping) -> str:
    names = ["hit_at_1", "hit_at_3", "hit_at_5", "hit_at_10", "mrr", "median_ms", "tokens_per_s", "reliability_any", "failures"]
    rows = ["| model | " + " | ".join(names) + " |", "|" + "---|" * (len(names) + 1)]
    rows += [f"| {m} | " + " | ".join(str(v.get(n, "")) for n in names) + " |" for m, v in document["models"].items()]
    return f"# {document['workload']} {document['workload_version']}\n\n{document['timestamp']}, frozen as {document['frozen']}\n\n" + "\n".join(rows) + "\n"


# ---------------------------------------------------------------- questions to stored runs


def document_of(spark: SparkSession, folder: str) -> dict:
    text = sinks.read_text(spark, f"{folder.rstrip('/')}/metrics.json")
    if text is None:
        raise WorkloadError(f"no run at {folder}")
    return json.loads(text)


def compare(spark: SparkSession, before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """(metric, before, after, change, percent, p) of two (folder, model); p of retrieval metrics by the paired test over their queries."""
    sides = []
    for label, (folder, model) in (("before", before), ("after", after)):
        m = document_of(spark, folder)["models"][model]
        sides += [(label, k, float(v)) for k, v in m.items() if isinstance(v, (int, float)) and k not in ("n_queries",)]
    table = evaluate.compare(spark.createDataFrame(sides, "run string, metric string, value double"), "run", "before", "after")
    a, b = (spark.read.parquet(f"{f.rstrip('/')}/model={m}/ranks").select("query_id", F.col("first_rank").alias(n)) for n, (f, m) in zip("ab", (before, after), strict=True))

    def values(rank: str) -> list[Column]:
        return [*[F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0)) for k in evaluate.KS], F.coalesce(1.0 / F.col(rank), F.lit(0.0))]

    names = [*[f"hit_at_{k}" for k in evaluate.KS], "mrr"]
    each = F.array(*[F.struct(F.lit(n).alias("metric"), x.alias("a"), y.alias("b")) for n, x, y in zip(names, values("a"), values("b"), strict=True)])
    tested = evaluate.paired_test(a.join(b, "query_id").select(F.explode(each).alias("x")).select("x.*"), "a", "b", ["metric"])
    return table.join(tested.select("metric", "p"), "metric", "left").orderBy("metric")


def candidates(spark: SparkSession, out: str) -> DataFrame:
    """(model, run, hit_at_10, latency_ms, ram_mb) of every model of every run below a folder; a model's newest run counts."""
    p, fs = artifacts._hadoop(spark, out)
    newest: dict[str, tuple] = {}
    for x in sorted(str(x.getPath()) for x in fs.listStatus(p)) if fs.exists(p) else []:
        if sinks.read_text(spark, f"{x}/metrics.json"):
            d = document_of(spark, x)
            for name, m in d["models"].items():
                if name not in newest or newest[name][0] <= d["timestamp"]:
                    newest[name] = (d["timestamp"], name, x.rsplit("/", 1)[-1], m.get("hit_at_10"), m.get("median_ms"), m.get("peak_mb"))
    return spark.createDataFrame([v[1:] for v in newest.values()], "model string, run string, hit_at_10 double, latency_ms double, ram_mb double")


def debug_case(spark: SparkSession, folder: str, model: str, workload: str, case: str) -> dict:
    """All that is known of one case: the unit, its prompt and attempts, and where queries found it, with relevance."""
    w = load(spark, workload)
    unit = w.units.filter(F.col("id") == case)
    row = unit.first()
    if row is None:
        raise WorkloadError(f"no such case: {case}")
    place = f"{folder.rstrip('/')}/model={model}"
    raw = spark.read.parquet(f"{place}/raw").filter((F.col("id") == case) & (F.col("repetition") == 0)).first()
    found = spark.read.parquet(f"{place}/results").filter(F.col("code_unit_id") == case).join(w.qrels.select("query_id", "code_unit_id", "relevance_score"), ["query_id", "code_unit_id"], "left").orderBy("rank", "query_id").limit(20).collect()
    prompt = prompts.blind(unit).select(prompts.label_prompt().alias("p")).first().p
    return {
        "unit": {k: row[k] for k in ("id", "symbol", "file_path", "language", "source_file_lines")},
        "prompt": prompt,
        "success": raw and raw.success,
        "duration_ms": raw and raw.generation_ms,
        "attempts": [x.asDict() for x in raw.attempts] if raw else [],
        "found_by": [{"query": r.query_id, "rank": r["rank"], "relevant": (r.relevance_score or 0) > 0} for r in found],
    }
