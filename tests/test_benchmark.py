"""Configuration, benchmark runs with replayed models, stored runs, and the command line."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corvane import cli, config
from corvane.operators import evaluate, generate
from corvane.plans import benchmark, jobs
from corvane.schemas import PERSISTED_UNIT
from corvane.sources import sinks, system

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import this module
TOPICS = ["payments", "parsing", "sorting", "caching", "logging", "network", "images", "users"]


def label(topic, i):
    return json.dumps({"description": f"This function is about {topic} number n{i} " + " ".join(f"and {topic}{k}" for k in range(9)), "summary": f"{topic} n{i}", "concepts": [topic, f"n{i}"]})


@pytest.fixture(scope="module")
def workload(tmp_path_factory):
    folder = tmp_path_factory.mktemp("w") / "code"
    folder.mkdir()
    units, queries, qrels = [], [], []
    for i in range(24):
        split, repo = (("train", "r1"), ("test", "r2"))[i >= 8]
        units.append({"id": f"u{i:02d}", "repository": repo, "language": "python", "file_path": f"a/{i}.py", "symbol": f"f{i}", "symbol_type": "function", "source_code": f"def f{i}():\n    return {i}\n", "split": split, "is_public": True, "source_file_lines": 2})
    for i in range(8, 24):
        queries.append({"id": f"q{i}", "query": f"{TOPICS[i % 8]} n{i}", "query_style": "natural", "query_intent": "find", "relevant_code_units": [f"u{i:02d}"], "split": "test"})
        qrels.append({"query_id": f"q{i}", "code_unit_id": f"u{i:02d}", "relevance_score": 1.0, "relevance_label": "direct_match"})
    for name, rows in (("units", units), ("queries", queries), ("qrels", qrels)):
        random.Random(1).shuffle(rows)
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (folder / "workload.json").write_text(json.dumps({"name": "code", "version": "1.0.0"}))
    return str(folder)


def factory(good):
    """A model that knows its cases, and one that mixes them up and fails on some."""

    def make():
        def answer(prompt):
            i = int(prompt.rsplit("def f", 1)[1].split("(")[0])
            if not good and i % 5 == 0:
                raise system.UnavailableError("timed out: late")
            return label(TOPICS[(i if good else i // 4) % 8], i if good else 99)

        return answer

    return make


SMALL = {"least_train": 8, "least_test": 16}


def test_run_compare_recommend_debug(spark, workload, tmp_path, capsys):
    out = str(tmp_path / "runs")
    c = config.Config(warmup_cases=2, repetitions=2)
    with pytest.raises(benchmark.WorkloadError, match="too small"):
        benchmark.run(spark, workload, {}, out, c)
    folder = benchmark.run(spark, workload, {"good": factory(True), "bad": factory(False)}, out, c, run_id="run-1", verify=SMALL)
    d = benchmark.document_of(spark, folder)
    good, bad = d["models"]["good"], d["models"]["bad"]
    assert good["hit_at_1"] == 1.0 and good["mrr"] == 1.0 and good["n_queries"] == 16 and good["failures"] == 0 and good["cases"] == 16 and good["reliability_first"] == 1.0
    assert bad["failures"] == 3 and bad["hit_at_1"] < 0.5 and 0 < bad["reliability_any"] < 1 and good["tokens_per_s"] > 0 and good["min_ms"] <= good["median_ms"] <= good["max_ms"]
    assert d["frozen"] == benchmark.load(spark, workload).digest and d["config"]["repetitions"] == 2 and "| good |" in sinks.read_text(spark, f"{folder}/report.md")
    assert spark.read.parquet(f"{folder}/model=good/raw").count() == 32

    table = {r.metric: r for r in benchmark.compare(spark, (folder, "bad"), (folder, "good")).collect()}
    ranks = {m: {r.query_id: r.first_rank for r in spark.read.parquet(f"{folder}/model={m}/ranks").collect()} for m in ("good", "bad")}
    diff = [(1 / ranks["good"][q] if ranks["good"][q] else 0) - (1 / ranks["bad"][q] if ranks["bad"][q] else 0) for q in ranks["good"]]
    n, mean = len(diff), sum(diff) / len(diff)
    t = mean / ((sum((x - mean) ** 2 for x in diff) / (n - 1)) ** 0.5 / n**0.5)
    assert table["mrr"].p == pytest.approx(evaluate.t_p_value(t, n), abs=1e-6) and table["mrr"].after == 1.0 and table["failures"].change == -3.0 and table["failures"].p is None

    models = benchmark.candidates(spark, out)
    assert evaluate.recommend(models, 0.9, 1e6, 1e6).first().model == "good" and models.count() == 2
    case = benchmark.debug_case(spark, folder, "good", workload, "u09")
    assert case["unit"]["symbol"] == "f9" and case["success"] and len(case["attempts"]) == 1 and "def f9" in case["prompt"]
    assert {"query": "q9", "rank": 1, "relevant": True} in case["found_by"]
    broken = benchmark.debug_case(spark, folder, "bad", workload, "u10")
    assert not broken["success"] and "timed out" in broken["attempts"][-1]["errors"][0]

    capsys.readouterr()
    assert cli.main(["compare", f"{folder}:bad", f"{folder}:good"]) == 0 and "mrr" in capsys.readouterr().out
    assert cli.main(["compare", folder, f"{folder}:good"]) == 1
    assert cli.main(["recommend", out, "--min-hit-at-10", "0.95"]) == 0 and "Recommended: good" in capsys.readouterr().out
    assert cli.main(["recommend", out, "--min-hit-at-10", "1.5"]) == 1
    capsys.readouterr()
    assert cli.main(["debug-case", folder, workload, "u09", "-m", "good"]) == 0 and json.loads(capsys.readouterr().out)["unit"]["id"] == "u09"
    assert cli.main(["workload", "list", workload.rsplit("/", 1)[0]]) == 0 and "code 1.0.0" in capsys.readouterr().out
    assert cli.main(["workload", "validate", workload]) == 1 and "FAIL train split too small" in capsys.readouterr().out  # eight units
    assert cli.main(["benchmark", workload, "--models", "m", "--server", "http://127.0.0.1:9"]) == 2 and cli.main(["benchmark", workload]) == 1


def test_checks_find_each_fault(spark, workload, tmp_path):
    w = benchmark.load(spark, workload)
    sound = {r.check: r.violations for r in benchmark.checks(w, **SMALL).collect()}
    assert set(sound.values()) == {0}
    bad = benchmark.Workload("x", "1", w.units.union(w.units.limit(1)).withColumn("repository", F.lit("r")), w.queries.withColumn("split", F.when(F.col("id") == "q9", "train").otherwise("test")), w.qrels.withColumn("relevance_score", F.lit(1.5)).withColumn("code_unit_id", F.when(F.col("query_id") == "q9", "none").otherwise(F.col("code_unit_id"))).filter("query_id <> 'q10'"), "")
    found = {r.check for r in benchmark.checks(bad, **SMALL).filter("violations > 0").collect()}
    assert {"repeated unit", "repository in two splits", "query outside of the test split", "score out of range", "relevance without unit"} <= found
    none = benchmark.Workload("x", "1", w.units.limit(0), w.queries.limit(0), w.qrels.limit(0), "")
    assert {r.check for r in benchmark.checks(none).filter("violations > 0").collect()} == {"train split too small", "test split too small", "low relevance coverage"}


def test_p_value(spark):
    rows = [(float(t), n) for t in (0.0, 0.3, 1.0, -2.5, 4.0, 40.0) for n in (2, 3, 5, 30, 1000, 200_000)]
    got = spark.createDataFrame(rows, "t double, n long").select("t", "n", evaluate.p_value(F.col("t"), F.col("n")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(evaluate.t_p_value(r.t, r.n), abs=2e-9), r
    assert spark.range(1).select(evaluate.p_value(F.lit(None).cast("double"), F.lit(5)).alias("p")).first().p is None


def test_settings_by_precedence(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text('# all\nworkload: "w-1"  # name\n\nmodels:\n  - "a"   # first\n  - b#1\ngeneration:\n  temperature: 0.5\n  max_tokens: 99\nbenchmark:\n  seed: 7\n  output_dir: "./x # y"\nextra: [1, two]\n')
    c = config.load(str(p), {})
    assert (c.workload, c.models, c.temperature, c.max_tokens, c.seed, c.output_dir, c.repetitions) == ("w-1", ("a", "b#1"), 0.5, 99, 7, "./x # y", 1)
    c = config.load(str(p), {"CORVANE_MODELS": "x, y", "CORVANE_SEED": "8", "CORVANE_TEMPERATURE": "0.1"}, {"seed": 9, "temperature": None})
    assert (c.models, c.seed, c.temperature) == (("x", "y"), 9, 0.1)
    assert config.load(None, {}) == config.Config()
    with pytest.raises(config.ConfigError):
        config.load(None, {"CORVANE_SEED": "many"})
    for text in ("- a\n", "word\n", "a: 1\n- b\n"):
        with pytest.raises(config.ConfigError):
            config.parse(text.splitlines())


def test_versions_and_metadata(spark, tmp_path):
    assert [sinks.bumped("1.2.3", x) for x in ("major", "minor", "patch")] == ["2.0.0", "1.3.0", "1.2.4"]
    with pytest.raises(ValueError):
        sinks.bumped("1.2", "minor")
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def xfuncx(x):\n    y = x\n    return y\n\n\nclass A:\n    def xmethodx(self):\n        z = 1\n        return z\n")
    out = str(tmp_path / "d")
    root = {"id": "r1", "path": str(src), "base_url": "", "split": "test", "commit": "c0"}
    jobs.build_dataset(spark, [root], out)
    meta = json.loads(sinks.read_text(spark, f"{out}/meta/version.json"))
    assert meta["version"] == "1.0.0" and meta["repository_splits"] == {"r1": "test"} and meta["total_code_units"] == meta["test_cases"] == 2 and meta["repository_commits"] == {"r1": "c0"}
    assert json.loads(sinks.read_text(spark, f"{out}/meta/stats.json"))["code_units"]["by_symbol_type"] == {"function": 1, "method": 1}
    good = json.dumps({"query": "sum of numbers", "query_style": "natural", "query_intent": "find"})
    units = spark.read.schema(PERSISTED_UNIT).json(f"{out}/splits")
    assert jobs.generate_queries(spark, units, f"{out}/queries", generate.replay({}, [good]), dataset_path=out) == jobs.OK
    after = json.loads(sinks.read_text(spark, f"{out}/meta/version.json"))
    assert after.pop("query_generation")["seed"] == 42 and after == meta
    counts = sinks.write_candidates(spark, jobs.RecordStore(spark, f"{out}/queries").read(), out)
    assert counts["total_queries"] == 2 and json.loads(sinks.read_text(spark, f"{out}/meta/version.json"))["total_queries"] == 2
    assert sinks.write_version(spark, out, meta | {"total": 2, "extracted": 2, "duplicates": 0, "train": 0, "validation": 0, "test": 2}, [root], "h", "minor")["version"] == "1.1.0"
    assert "query_generation" in json.loads(sinks.read_text(spark, f"{out}/meta/version.json"))


def test_machine(spark, tmp_path):
    said = "Card A, 24576, 100\nCard B, [N/A], 0\n"
    assert system.gpus(lambda *a: said) == [{"name": "Card A", "memory_mb": 24576, "used_mb": 100}, {"name": "Card B", "memory_mb": None, "used_mb": 0}]

    def absent(*args):
        raise FileNotFoundError

    assert system.gpus(absent) == []
    e = system.environment(spark, {"seed": 1}, system.http_fetch("http://127.0.0.1:9", 0.5))
    assert e["models"] is None and e["settings"] == {"seed": 1} and e["process_mb"] > 1 and e["machine"]["logical_cores"] > 0
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("x = 1\n")
    for args in (("init", "-b", "main"), ("add", "."), ("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-m", "c"), ("tag", "v1")):
        system.git(*args, cwd=str(src))
    got = system.shallow_clone(f"file://{src}", str(tmp_path / "ws"), "v1")
    assert len(got["commit"]) == 40 and got | {"url": "nowhere"} == system.shallow_clone("nowhere", str(tmp_path / "ws"), "v1")  # reused
