"""Artifacts, stores, locks, streams and the jobs that repair and merge."""

import json
import random

import pytest

from corvane.operators import generate
from corvane.plans import jobs
from corvane.schemas import AUDIT
from corvane.sources import artifacts, sinks, system
from corvane.streaming.checkpoint import Breaker, Locked, RecordStore, Repeated, RunLock, failing_runs, generate_stream, pace

GOOD = json.dumps({"query": "sum of numbers", "query_style": "natural", "query_intent": "find"})


def rec(unit, ok=True, at="2026-01-01T00:00:00", **more):
    base = {"code_unit_id": unit, "candidate_id": f"candidate_{unit}", "query": "q" if ok else "", "query_style": "natural", "query_intent": "i", "model": "m", "model_version": "", "prompt_version": "1", "seed": 42, "temperature": 0.7, "top_p": 0.9, "max_tokens": 128}
    return base | {"attempt_count": 1, "attempts": [], "generation_ms": 1.0, "validation_ms": 0.0, "validation_passed": ok, "leakage_passed": ok, "leakage_violations": [], "success": ok, "failure_category": None if ok else "timeout", "failure_reason": None, "completed_utc": at} | more


def write(path, rows, tail=""):
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in rows) + tail)
    return str(path)


def test_strict_scan(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", [rec("u1"), "", rec("u2")])
    assert artifacts.strict_records(spark, p, AUDIT).count() == 2
    assert artifacts.strict_records(spark, str(tmp_path / "none"), AUDIT).count() == 0
    for bad in ("[1]", "{", "x", '{"code_unit_id": 3, "success": true}', '{"code_unit_id": "", "success": true}', '{"code_unit_id": "a", "success": "true"}', '{"code_unit_id": "a"}'):
        with pytest.raises(artifacts.BrokenArtifact):
            artifacts.strict_records(spark, write(tmp_path / "b.jsonl", [rec("u1"), bad]), AUDIT)


@pytest.mark.parametrize("body, tail", [("", "torn"), ("a\nb\n", "c"), ("a\nb\n", ""), ("x" * 200_000 + "\n", "y" * 150_000), ("", "")])
def test_torn_end(spark, tmp_path, body, tail):
    p = tmp_path / "a.jsonl"
    p.write_text(body + tail)
    assert artifacts.repair_torn_end(spark, str(p)) == len(tail) and p.read_text() == body
    assert artifacts.repair_torn_end(spark, str(tmp_path / "none")) == 0


def test_load_store(spark, tmp_path):
    a, b = write(tmp_path / "a", [rec("u1")]), write(tmp_path / "b", [rec("u2", False)])
    x, y = artifacts.load_store(spark, a, b, AUDIT)
    assert (x.count(), y.count()) == (1, 1)
    for first, second in (([rec("u1"), rec("u1")], []), ([rec("u1", False)], []), ([rec("u1")], [rec("u1", False)])):
        with pytest.raises(artifacts.BrokenArtifact):
            artifacts.load_store(spark, write(tmp_path / "c", first), write(tmp_path / "d", second), AUDIT)


RECORDS = (
    [rec("once"), rec("dup"), rec("dup"), rec("tele", at="2026-01-02"), rec("tele", at="2026-01-01", generation_ms=9.0)],
    [rec("early"), rec("none", False, "2026-01-01"), rec("none", False, "2026-01-03"), rec("early", False, "2025-01-01")],
)
CONFLICTS = [rec("says"), rec("says", query="other"), rec("how"), rec("how", seed=1), rec("id", candidate_id="x"), rec("late"), rec("late", False, "2027-01-01")]


def artifacts_of(tmp_path, rows, name):
    folder = tmp_path / name
    folder.mkdir()
    return write(folder / "s", [r for r in rows if r["success"]]), write(folder / "f", [r for r in rows if not r["success"]])


def lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_recover_and_merge(spark, tmp_path):
    rows = [*RECORDS[0], *RECORDS[1]]
    out = []
    for k in range(3):  # any order of records gives the same bytes
        random.Random(k).shuffle(rows)
        assert jobs.recover(spark, *artifacts_of(tmp_path, rows, f"in{k}"), str(tmp_path / f"out{k}")) == jobs.OK
        v = sinks.Versions(spark, str(tmp_path / f"out{k}")).current()
        out.append((lines(spark, f"{v}/successes"), lines(spark, f"{v}/failures")))
    assert out[0] == out[1] == out[2]
    good, bad = ([json.loads(x) for x in side] for side in out[0])
    assert [r["code_unit_id"] for r in good] == ["dup", "early", "once", "tele"] and good[3]["generation_ms"] == 9.0
    assert [(r["code_unit_id"], r["completed_utc"]) for r in bad] == [("none", "2026-01-03")]
    mixed = artifacts_of(tmp_path, rows + CONFLICTS, "mixed")
    assert jobs.recover(spark, *mixed, str(tmp_path / "m")) == jobs.CONFLICTS
    assert jobs.recover(spark, *mixed, str(tmp_path / "m"), isolate=True, dry_run=True) == jobs.OK and sinks.Versions(spark, str(tmp_path / "m")).current() is None
    assert jobs.recover(spark, *mixed, str(tmp_path / "m"), isolate=True) == jobs.OK
    v = sinks.Versions(spark, str(tmp_path / "m")).current()
    assert lines(spark, f"{v}/successes") == out[0][0] and len(lines(spark, f"{v}/quarantined")) == len(CONFLICTS)
    kinds = json.loads(sinks.read_text(spark, f"{v}/conflicts.json"))["kinds"]
    assert kinds == {"semantic_candidate_conflict": 1, "methodology_mismatch": 1, "candidate_id_mismatch": 1, "failure_supersedes_success": 1}
    staged = artifacts_of(tmp_path, [rec("says"), rec("late", False)], "staged")
    store = (f"{v}/successes", f"{v}/failures")
    assert jobs.merge(spark, store, staged, str(tmp_path / "merged")) == jobs.OK
    w = sinks.Versions(spark, str(tmp_path / "merged")).current()
    assert len(lines(spark, f"{w}/successes")) == 5 and len(lines(spark, f"{w}/failures")) == 2
    assert jobs.merge(spark, (f"{w}/successes", f"{w}/failures"), staged, str(tmp_path / "merged")) == jobs.OK  # done before
    assert jobs.merge(spark, store, artifacts_of(tmp_path, [rec("once", query="new")], "clash"), str(tmp_path / "x")) == jobs.ERROR
    assert jobs.merge(spark, store, artifacts_of(tmp_path, [rec("new", seed=7)], "drift"), str(tmp_path / "x")) == jobs.ERROR


def test_subset(spark, tmp_path):
    p = write(tmp_path / "split", ['{"id": "a",  "x": 1}', '{"id": "b"}', '{"id":"c"}', '{"id": "c"}'])
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert jobs.build_subset(spark, p, ids, str(tmp_path / "o")) == jobs.OK and sorted(lines(spark, str(tmp_path / "o"))) == ['{"id": "a",  "x": 1}', '{"id": "b"}']
    for bad in ("z", "c"):
        assert jobs.build_subset(spark, p, spark.createDataFrame([(bad,)], "id string"), str(tmp_path / "o2")) == jobs.ERROR


def units(spark, ids):
    row = lambda i: (i, "repo", f"p/{i}.py", f"sym{i}", "function", "def f():\n    pass\n", "", (None, None, [], []))
    return spark.createDataFrame([row(i) for i in ids], "id string, repository string, file_path string, symbol string, symbol_type string, source_code string, docstring string, context struct<class_name:string,module_docstring:string,imports:array<string>,parent_methods:array<string>>")


def test_generation_resumes(spark, tmp_path):
    out = str(tmp_path / "g")
    u = units(spark, [f"u{i}" for i in range(6)])
    factory = generate.replay({}, [GOOD])
    assert jobs.generate_queries(spark, u, out, factory, limit=2) == jobs.OK and RecordStore(spark, out).read().count() == 2
    assert jobs.generate_queries(spark, u, out, factory, batch_units=2) == jobs.OK
    store = RecordStore(spark, out)
    store.verify()
    assert store.read().count() == 6 and store.pending(u).count() == 0
    assert json.loads(sinks.read_text(spark, f"{out}/metadata.json"))["success_rate"] == 1.0
    with pytest.raises(Repeated):
        store.append(store.read().limit(1))
    assert store.read().count() == 6
    assert jobs.generate_queries(spark, u.limit(0), out, factory) == jobs.ERROR
    assert jobs.generate_queries(spark, u, out, factory, reachable=lambda: False) == jobs.UNREACHABLE
    with RunLock(spark, out):
        assert jobs.generate_queries(spark, u, out, factory) == jobs.LOCKED
        with pytest.raises(Locked), RunLock(spark, out):
            pass
    assert jobs.generate_queries(spark, u, out, generate.replay({}), fresh=True) == jobs.BROKEN  # no answers: all calls fail
    # a task gives up after three of its own
    assert RecordStore(spark, out).read().count() == 3 and failing_runs(RecordStore(spark, out).read()) == (3, 3)


def test_breaker_counts_over_batches(spark, tmp_path):
    out, paces = str(tmp_path / "g"), []
    u = units(spark, [f"u{i}" for i in range(12)])
    # one unit a batch, of which none alone has three failures
    assert jobs.generate_queries(spark, u, out, generate.replay({}), batch_units=1, told=paces.append) == jobs.BROKEN
    store = RecordStore(spark, out)
    asked = store.read().count()
    assert 3 <= asked < 12 and paces[-1]["done"] == asked and paces[-1]["total"] == 12 and paces[-1]["eta_s"] > 0
    assert jobs.generate_queries(spark, u, out, generate.replay({}, [GOOD]), batch_units=4) == jobs.OK
    assert store.read().count() == 12 and store.read().filter("success").count() == 12 - asked
    meta = json.loads(sinks.read_text(spark, f"{out}/metadata.json"))
    assert meta["settings"]["seed"] == 42 and sum(meta["failure_breakdown"].values()) == asked and meta["style_distribution"] == {"natural": 12 - asked} and meta["wall_clock_s"] > 0
    assert pace(0, 5, 1.0)["eta_s"] is None


def plain_runs(flags, carried):
    longest = now = carried
    for x in flags:
        now = now + 1 if x else 0
        longest = max(longest, now)
    return longest, now


def test_failing_runs(spark):
    rng = random.Random(3)
    for n in (0, 1, 7, 300):
        flags = [rng.random() < 0.8 for _ in range(n)]
        rows = [(f"2026-01-01T{i:06d}", f"u{i}", "timeout" if x else "leakage", False) for i, x in enumerate(flags)]
        df = spark.createDataFrame(rows[::-1], "completed_utc string, code_unit_id string, failure_category string, success boolean").repartition(5)
        for carried in (0, 2):
            assert failing_runs(df, carried) == plain_runs(flags, carried)


def test_first_units_in_file_order(spark, tmp_path):
    p = tmp_path / "split"
    p.write_text("".join(json.dumps({"id": f"u{(i * 7919) % 5000:05d}", "pad": "x" * 200}) + "\n" + "\n" * (i % 3) for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = artifacts.file_order(spark, str(p), spark.createDataFrame([], "id string").schema)
        assert rows.rdd.getNumPartitions() > 4
        assert [r.id for r in rows.orderBy("place").limit(100).collect()] == [f"u{(i * 7919) % 5000:05d}" for i in range(100)]
        lines_ = [json.dumps(rec(f"u{i}")) for i in range(900)]
        lines_[700], lines_[50] = "{", ""
        with pytest.raises(artifacts.BrokenArtifact, match="bad:701: not a JSON object"):
            artifacts.strict_records(spark, write(tmp_path / "bad", lines_), AUDIT)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_equal_times_go_by_sorted_keys(spark, tmp_path):
    a = rec("u", generation_ms=2.0)
    b = dict(reversed(list(rec("u", generation_ms=1.0, zeta=1).items())))
    want = min((json.dumps(x, sort_keys=True), json.dumps(x)) for x in (a, b))[1]
    for k, rows in enumerate(([a, b], [b, a])):
        assert jobs.recover(spark, *artifacts_of(tmp_path, rows, f"k{k}"), str(tmp_path / f"ko{k}")) == jobs.OK
        v = sinks.Versions(spark, str(tmp_path / f"ko{k}")).current()
        assert lines(spark, f"{v}/successes") == [want]


def test_merge_plans_the_union(spark, tmp_path):
    store = artifacts_of(tmp_path, [rec("a"), rec("b", False)], "store")
    again = artifacts_of(tmp_path, [dict(reversed(list(rec("a").items())))], "again")
    assert jobs.merge(spark, store, again, str(tmp_path / "x")) == jobs.OK and sinks.Versions(spark, str(tmp_path / "x")).current() is None  # the same record with other key order
    assert jobs.merge(spark, store, artifacts_of(tmp_path, [rec("c", candidate_id="other")], "bad"), str(tmp_path / "x")) == jobs.ERROR
    fresh = artifacts_of(tmp_path, [rec("c", seed=7), rec("d", False)], "fresh")
    assert jobs.merge(spark, store, fresh, str(tmp_path / "x"), dry_run=True, one_method=False) == jobs.OK and sinks.Versions(spark, str(tmp_path / "x")).current() is None
    assert jobs.merge(spark, store, fresh, str(tmp_path / "x"), one_method=False) == jobs.OK
    v = sinks.Versions(spark, str(tmp_path / "x")).current()
    assert sorted(json.loads(x)["code_unit_id"] for x in lines(spark, f"{v}/successes") + lines(spark, f"{v}/failures")) == ["a", "b", "c", "d"]


def test_errors_of_the_server_have_categories(spark):
    import socket

    from pyspark.sql import functions as F

    from corvane.operators.runs import classify_failure, legacy_metadata

    silent = socket.socket()
    silent.bind(("127.0.0.1", 0))
    silent.listen()
    told = []
    for url, timeout in ((f"http://127.0.0.1:{silent.getsockname()[1]}", 0.3), ("http://127.0.0.1:9", 1.0)):
        out = generate.run_with_retry("p", generate.CANDIDATE, system.remote_model(url, "m", timeout=timeout)())
        told.append((out.attempts[-1]["errors"][0],))
    silent.close()
    df = spark.createDataFrame(told, "e string")
    got = df.select("e", classify_failure(F.lit(False), F.lit(1), F.lit("failed"), F.col("e")).alias("c")).collect()
    assert [r.c for r in got] == ["timeout", "provider_unavailable"], got
    legacy = legacy_metadata(spark.createDataFrame([(True, None), (False, "leakage")], "success boolean, failure_category string")).first()
    assert tuple(legacy) == (2, 1, 1, 0)


def test_stream(spark, tmp_path):
    source, store = str(tmp_path / "in"), RecordStore(spark, str(tmp_path / "s"))
    units(spark, ["a", "b"]).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def make(answers):
        def run(u):
            from corvane.functions import prompts

            asked = prompts.blind(u).select("id", prompts.query_prompt().alias("prompt"))
            return generate.audit_records(generate.generate(asked, generate.replay({}, answers)), u)

        return run

    generate_stream(spark, source, schema, store, make([GOOD])).awaitTermination()
    units(spark, ["b", "c"]).coalesce(1).write.mode("append").parquet(source)
    generate_stream(spark, source, schema, store, make([GOOD])).awaitTermination()
    assert sorted(r.code_unit_id for r in store.read().collect()) == ["a", "b", "c"]
    units(spark, ["d", "e", "f"]).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="in a row"):
        generate_stream(spark, source, schema, store, make(None)).awaitTermination()
    assert store.read().count() == 6 and Breaker


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k long, v string")
    for fmt in ("csv", "json", "md"):
        sinks.export(df, str(tmp_path / f"e.{fmt}"), fmt)
    assert (tmp_path / "e.md").read_text().splitlines()[2] == "| 1 | a\\|b |"
    with pytest.raises(ValueError):
        sinks.export(df, "x", "pdf")
    with pytest.raises(sinks.RepeatedKey):
        sinks.sorted_lines(df.union(df).withColumnRenamed("v", "raw"), "k")
    sinks.write_run({"results": df}, str(tmp_path / "runs"), "r1")
    assert spark.read.json(str(tmp_path / "runs/results")).count() == 2


def test_system(spark, tmp_path):
    tags = {"models": [{"name": "b:latest", "size": 1024**3, "modified_at": "t"}, {"name": "a:7b", "size": None}]}
    rows = system.models(spark, lambda path, body: tags).collect()
    assert [(r.name, r.size_gb) for r in rows] == [("a:7b", None), ("b", 1.0)]
    assert system.runtime_metadata(lambda p, b: tags, "b") == {"size": 1024**3, "modified_at": "t"} and system.runtime_metadata(lambda p, b: {}["x"], "b") == {}
    assert system.system_profile(spark).count() == 1
    reg = system.ModelRegistry()
    reg.add("x", 1)
    reg.add("x", 2)
    assert reg.get("x") == 2 and reg.list() == ["x"] and reg.has("x")
    with pytest.raises(system.ModelNotFoundError):
        reg.get("y")
    with pytest.raises(system.UnavailableError):
        system.http_fetch("http://127.0.0.1:9", 1.0)("/", None)
    assert not system.healthy(system.http_fetch("http://127.0.0.1:9", 1.0))
    m = [{"id": "r", "split": "train"}]
    assert system.manifest(spark, m).count() == 1 and len(system.manifest_hash(m)) == 64
    with pytest.raises(system.RepositoryError):
        system.manifest(spark, m + m)


def test_git(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("x = 1\n")
    for args in (("init", "-b", "main"), ("add", "."), ("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-m", "c"), ("tag", "v1")):
        system.git(*args, cwd=str(src))
    got = system.acquire(str(src), str(tmp_path / "ws"), "v1")
    assert len(got["commit"]) == 40 and got == system.acquire(str(src), str(tmp_path / "ws"), "v1")
    with pytest.raises(system.RepositoryError):
        system.acquire(str(src), str(tmp_path / "ws"), "nope")
