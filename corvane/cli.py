"""A thin command line: system, models, ask, benchmark, compare, recommend, workload, debug-case, query, export.

Settings come from --config, from variables that begin with CORVANE_ and from options, later ones first.
"""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__
from .session import session


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corvane")
    parser.add_argument("--version", action="version", version=__version__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("system", help="the driver's machine")
    for name in ("models", "ask"):
        p = sub.add_parser(name)
        p.add_argument("--server", dest="base_url")
        if name == "ask":
            p.add_argument("-m", "--model", required=True)
            p.add_argument("prompt")
    p = sub.add_parser("benchmark", help="run models over a workload")
    p.add_argument("workload_path", help="folder of the workload")
    p.add_argument("--config")
    for name, kind in (("models", str), ("temperature", float), ("max-tokens", int), ("timeout-seconds", float), ("retry-max-attempts", int), ("seed", int), ("warmup-cases", int), ("repetitions", int), ("output-dir", str)):
        p.add_argument(f"--{name}", type=kind)
    p.add_argument("--server", dest="base_url")
    p = sub.add_parser("compare", help="two models of stored runs")
    for side in ("before", "after"):
        p.add_argument(side, help="folder of a run, with :model where it has several")
    p = sub.add_parser("recommend", help="the best model within limits")
    p.add_argument("runs", help="folder of runs")
    p.add_argument("--min-hit-at-10", type=float, default=0.0)
    p.add_argument("--max-latency-ms", type=float, default=float("inf"))
    p.add_argument("--max-ram-gb", type=float, default=float("inf"))
    p = sub.add_parser("workload")
    p.add_argument("action", choices=("list", "validate"))
    p.add_argument("path", help="folder of workloads, or of one")
    p = sub.add_parser("debug-case")
    for name in ("run", "workload_path", "case"):
        p.add_argument(name)
    p.add_argument("-m", "--model", required=True)
    for name in ("query", "export"):
        p = sub.add_parser(name)
        p.add_argument("name")
        p.add_argument("tables", help="folder of Parquet tables")
        if name == "export":
            p.add_argument("path")
            p.add_argument("--format", default="csv", choices=("csv", "json", "md"))
    return parser


def _side(spark, text: str) -> tuple[str, str]:
    from .plans import benchmark

    folder, _, model = text.rpartition(":") if ":" in text.rsplit("/", 1)[-1] else (text, "", "")
    models = list(benchmark.document_of(spark, folder)["models"])
    if not model and len(models) != 1:
        raise benchmark.WorkloadError(f"{folder} has the models {', '.join(models)}: name one as {folder}:model")
    return folder, model or models[0]


def _run(args: argparse.Namespace) -> int:
    from . import config
    from .plans import benchmark, registry
    from .sources import sinks, system

    settings = config.load(getattr(args, "config", None), flags=vars(args))
    if args.command == "ask":
        print(system.remote_model(settings.base_url, args.model)()(args.prompt))
        return 0
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "system":
        system.system_profile(spark).show(truncate=False, vertical=True)
    elif args.command == "models":
        system.models(spark, system.http_fetch(settings.base_url)).show(truncate=False)
    elif args.command == "benchmark":
        if not settings.models:
            print("no models: name some with --models, CORVANE_MODELS or in the configuration", file=sys.stderr)
            return 1
        if not system.healthy(system.http_fetch(settings.base_url, settings.timeout_seconds)):
            print(f"no server at {settings.base_url}", file=sys.stderr)
            return 2
        models = {m: system.remote_model(settings.base_url, m, settings.temperature, settings.max_tokens, seed=settings.seed, timeout=settings.timeout_seconds) for m in settings.models}
        folder = benchmark.run(spark, args.workload_path, models, settings.output_dir, settings)
        print(sinks.read_text(spark, f"{folder}/report.md"))
        print(folder)
    elif args.command == "compare":
        benchmark.compare(spark, _side(spark, args.before), _side(spark, args.after)).show(50, truncate=False)
    elif args.command == "recommend":
        from .operators import evaluate

        limits = (args.min_hit_at_10, args.max_latency_ms, args.max_ram_gb * 1024)
        table = benchmark.candidates(spark, args.runs)
        best = evaluate.recommend(table, *limits).first()
        print(f"Recommended: {best.model}" if best else "No model keeps all limits.")
        evaluate.reject_reasons(table, *limits).orderBy("model").show(100, truncate=False)
        return 0 if best else 1
    elif args.command == "workload":
        if args.action == "list":
            for w in benchmark.workloads(spark, args.path):
                print(f"{w['name']} {w['version']}  {w['path']}")
        else:
            found = benchmark.checks(benchmark.load(spark, args.path)).collect()
            for r in found:
                print(f"{'ok  ' if not r.violations else 'FAIL'} {r.check}: {r.violations}")
            return int(any(r.violations for r in found))
    elif args.command == "debug-case":
        print(json.dumps(benchmark.debug_case(spark, args.run, args.model, args.workload_path, args.case), indent=2, ensure_ascii=False))
    elif args.name not in registry.QUERIES:
        print(f"no such query: {args.name}", file=sys.stderr)
        return 1
    elif args.command == "query":
        registry.QUERIES[args.name](spark, args.tables).show(50, truncate=80)
    else:
        sinks.export(registry.QUERIES[args.name](spark, args.tables), args.path, args.format)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)

    from .config import ConfigError
    from .plans.benchmark import WorkloadError
    from .sources import system

    try:
        return _run(args)
    except (system.UnavailableError, system.ModelNotFoundError, system.GenerationError, WorkloadError, ConfigError, FileNotFoundError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
