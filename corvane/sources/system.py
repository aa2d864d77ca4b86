"""Sources on the driver's side of a run: repositories, the model server, the machine."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import shutil
import subprocess
import sys
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import size_gb
from ..schemas import REPOSITORY


Fetch = Callable[[str, dict | None], dict]


class RepositoryError(RuntimeError):
    pass


class ModelNotFoundError(RuntimeError):
    pass


class UnavailableError(RuntimeError):
    pass


class GenerationError(RuntimeError):
    pass


def git(*args: str, cwd: str | None = None, timeout: int = 600) -> str:
    try:
        done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, timeout=timeout, check=True)
    except FileNotFoundError as e:
        raise RepositoryError("git isn't installed") from e
    except subprocess.TimeoutExpired as e:
        raise RepositoryError(f"git {args[0]} took more than {timeout} s") from e
    except subprocess.CalledProcessError as e:
        raise RepositoryError(e.stderr.strip() or f"git {args[0]} failed") from e
    return done.stdout.strip()


def acquire(url: str, workspace: str, revision: str = "main") -> dict:
    """Clone or fetch a repository, check a revision out and describe it: path, commit, reference, content_hash."""
    target = Path(workspace)
    if not (target / ".git").is_dir():
        if target.exists():
            shutil.rmtree(target)
        target.parent.mkdir(parents=True, exist_ok=True)
        git("clone", url, str(target))
    else:
        git("fetch", "--all", "--tags", cwd=workspace)
    commit = ""
    for ref in (f"origin/{revision}", revision):
        try:
            commit = git("rev-parse", "--verify", f"{ref}^{{commit}}", cwd=workspace)
            break
        except RepositoryError:
            continue
    if len(commit) < 40:
        raise RepositoryError(f"no such revision: {revision}")
    git("checkout", "--detach", commit, cwd=workspace)
    return {"url": url, "local_path": str(target), "commit": commit, "reference": revision, "content_hash": directory_hash(workspace)}


def shallow_clone(url: str, workspace: str, revision: str) -> dict:
    """One commit of a repository without its history: path and commit. A folder that is there already is taken as it is."""
    target = Path(workspace)
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        git("clone", "--depth=1", url, str(target))
        git("fetch", "--depth=1", "origin", revision, cwd=workspace)
        git("checkout", "--detach", "FETCH_HEAD", cwd=workspace)
    return {"url": url, "local_path": str(target), "commit": git("rev-parse", "HEAD", cwd=workspace), "reference": revision}


def gpus(run: Callable[..., str] | None = None) -> list[dict]:
    """Name and memory of the graphics cards that the vendor's tool tells of; none without it."""
    ask = run or (lambda *args: subprocess.run(args, capture_output=True, text=True, timeout=10, check=True).stdout)
    try:
        said = ask("nvidia-smi", "--query-gpu=name,memory.total,memory.used", "--format=csv,noheader,nounits")
    except (OSError, subprocess.SubprocessError):
        return []
    rows = [[x.strip() for x in line.split(",")] for line in said.splitlines() if line.count(",") >= 2]
    number = lambda x: int(x) if x.isdigit() else None
    return [{"name": ",".join(r[:-2]), "memory_mb": number(r[-2]), "used_mb": number(r[-1])} for r in rows]


def process_mb() -> float | None:
    """Resident memory of this process; null where the system doesn't tell."""
    try:
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / (1 << 20)
    except (OSError, ValueError, IndexError):
        return None


def environment(spark: SparkSession, settings: dict, fetch: Fetch | None = None) -> dict:
    """What a run depends on: machine, graphics cards, versions, settings, and the server's models if there is one."""
    try:
        offered = [r.asDict() for r in models(spark, fetch).limit(1000).collect()] if fetch else None
    except (UnavailableError, ModelNotFoundError, GenerationError):
        offered = None
    return {"machine": system_profile(spark).first().asDict(), "gpus": gpus(), "process_mb": process_mb(), "settings": settings, "models": offered}


def directory_hash(root: str) -> str:
    """SHA-256 over the paths and bytes of all files in path order, without version control's own."""
    digest = hashlib.sha256()
    base = Path(root)
    for path in sorted(p for p in base.rglob("*") if p.is_file() and ".git" not in p.parts):
        digest.update(str(path.relative_to(base)).encode())
        digest.update(path.read_bytes())
    return digest.hexdigest()


def manifest(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Repositories of a dataset; unknown splits and repeated ids are refused."""
    ids = [r["id"] for r in rows]
    if len({*ids}) != len(ids) or any(r.get("split") not in ("train", "validation", "test") for r in rows):
        raise RepositoryError("ids must be unique and splits known")
    return spark.createDataFrame([tuple(r.get(f.name) for f in REPOSITORY.fields) for r in rows], REPOSITORY)


def manifest_hash(rows: list[dict]) -> str:
    return hashlib.sha256(json.dumps(rows, sort_keys=True).encode()).hexdigest()


def http_fetch(base: str, timeout: float = 60.0) -> Fetch:
    """JSON over HTTP: a GET without a body, else a POST."""

    def fetch(path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        ask = urllib.request.Request(base.rstrip("/") + path, data=data, headers={"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(ask, timeout=timeout) as answer:
                text = answer.read().decode()
        except urllib.error.HTTPError as e:
            said = e.read().decode(errors="replace")
            if e.code == 404 or "not found" in said.lower() or "does not exist" in said.lower():
                raise ModelNotFoundError(said) from e
            raise GenerationError(f"{e.code}: {said}") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise UnavailableError(f"{'timed out' if 'timed out' in str(e) else 'no answer'}: {e}") from e
        return json.loads(text) if text.strip().startswith(("{", "[")) else {"text": text}

    return fetch


def models(spark: SparkSession, fetch: Fetch) -> DataFrame:
    """Models that a server offers, by name; the tag `latest` is left off."""
    rows = [(m.get("name", ""), (m.get("details") or {}).get("parameter_size"), (m.get("details") or {}).get("quantization_level"), m.get("size"), m.get("modified_at")) for m in fetch("/api/tags", None).get("models", [])]
    df = spark.createDataFrame(rows, "name string, parameter_count string, quantization string, size_bytes long, modified_at string")
    return df.withColumn("name", F.regexp_replace("name", ":latest$", "")).withColumn("size_gb", size_gb(F.col("size_bytes"))).orderBy("name")


def healthy(fetch: Fetch) -> bool:
    try:
        fetch("/", None)
    except (UnavailableError, GenerationError, ModelNotFoundError):
        return False
    return True


def remote_model(base: str, name: str, temperature: float = 0.7, max_tokens: int = 128, top_p: float = 0.9, seed: int | None = None, timeout: float = 60.0):
    """A factory for `operators.generate`; a seed is sent only if there is one."""

    def factory():
        fetch = http_fetch(base, timeout)
        options = {"temperature": temperature, "num_predict": max_tokens, "top_p": top_p} | ({} if seed is None else {"seed": seed})

        def answer(prompt: str) -> str:
            got = fetch("/api/generate", {"model": name, "prompt": prompt, "stream": False, "options": options})
            if got.get("error"):
                raise GenerationError(got["error"])
            return got.get("response", "")

        return answer

    return factory


def runtime_metadata(fetch: Fetch, name: str) -> dict:
    """Size and time of a model, as far as the server tells; nothing if it doesn't."""
    try:
        found = next((m for m in fetch("/api/tags", None).get("models", []) if m.get("name", "").removesuffix(":latest") == name), {})
    except Exception:  # metadata only
        return {}
    return {k: found[k] for k in ("size", "modified_at") if k in found}


def system_profile(spark: SparkSession) -> DataFrame:
    """One row about the driver's machine; what can't be found out is null."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        free = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_AVPHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        total = free = None
    row = (platform.system(), platform.release(), platform.machine(), sys.version.split()[0], platform.processor() or None, os.cpu_count(), total, free, spark.version, spark.sparkContext.defaultParallelism)
    return spark.createDataFrame([row], "os string, os_version string, architecture string, python_version string, cpu_model string, logical_cores long, memory_total long, memory_available long, spark_version string, parallelism long")


class ModelRegistry:
    """Models by name; the last of a name wins."""

    def __init__(self) -> None:
        self._models: dict[str, object] = {}

    def add(self, name: str, model: object) -> None:
        self._models[name] = model

    def get(self, name: str) -> object:
        if name not in self._models:
            raise ModelNotFoundError(name)
        return self._models[name]

    def has(self, name: str) -> bool:
        return name in self._models

    def list(self) -> list[str]:
        return sorted(self._models)

    def clear(self) -> None:
        self._models.clear()
