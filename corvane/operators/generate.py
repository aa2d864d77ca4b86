"""Generating with a model that answers text: bounded retry, leak check, audit records. The model is any picklable factory of
a function from prompt to text; `replay` answers from a table, so that runs need no network.

A Spark task that is tried again asks the model again. Persist the records (`streaming.checkpoint`) before a second action,
and leave speculation off for the stage.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.structured import CANDIDATE, ConstraintViolationError, MalformedJSONError, MissingFieldError, Schema, StructuredError, TypeMismatchError, corrective_prompt, validate

Model = Callable[[str], str]
Factory = Callable[[], Model]


class ProviderError(RuntimeError):
    """The model can't be reached or failed."""


@dataclass(frozen=True)
class Retry:
    """attempts: 1 or more. kinds: errors after which another attempt makes sense; all errors of an attempt must be such."""

    attempts: int = 3
    kinds: tuple[type, ...] = (MalformedJSONError, MissingFieldError, TypeMismatchError, ConstraintViolationError)

    def __post_init__(self) -> None:
        if self.attempts < 1:
            raise ValueError("at least one attempt is needed")


@dataclass
class Outcome:
    success: bool
    data: dict | None = None
    attempts: list[dict] = field(default_factory=list)
    generation_ms: float = 0.0
    validation_ms: float = 0.0


def run_with_retry(prompt: str, schema: Schema, model: Model, retry: Retry = Retry()) -> Outcome:
    """Ask until an answer is valid. A failed call ends it; a retry repeats the first prompt with the latest errors."""
    out, ask = Outcome(False), prompt
    for number in range(1, retry.attempts + 1):
        start = time.perf_counter()
        try:
            raw: str | None = model(ask)
            errors: list[Exception] = []
        except Exception as e:  # whatever the model raises is an outcome, not a fault of ours
            raw, errors = None, [e]
        took = (time.perf_counter() - start) * 1000
        out.generation_ms += took
        data = None
        if raw is not None:
            start = time.perf_counter()
            data, found = validate(raw, schema)
            errors = list(found)
            out.validation_ms += (time.perf_counter() - start) * 1000
        again = raw is not None and data is None and number < retry.attempts and all(isinstance(e, retry.kinds) for e in errors)
        told = [str(e) if isinstance(e, StructuredError) else f"{type(e).__name__}: {e}" for e in errors]
        out.attempts.append({"attempt_number": number, "status": "failed" if data is None else "success", "will_retry": again, "generation_ms": took, "errors": told, "raw_text": raw or ""})
        if data is not None:
            out.success, out.data = True, data
        if not again:
            break
        ask = f"{prompt}\n\n{corrective_prompt(told)}"
    return out


def replay(answers: Mapping[str, list[str]], default: list[str] | None = None) -> Factory:
    """Answers of recorded prompts, in order; the part before a corrective suffix is the prompt. The last answer repeats."""

    def factory() -> Model:
        used: dict[str, int] = {}

        def answer(prompt: str) -> str:
            key = next((k for k in answers if prompt == k or prompt.startswith(k + "\n\n")), None)
            texts = answers[key] if key is not None else default
            if texts is None:
                raise ProviderError("no recorded answer")
            n = used.get(key or "", 0)
            used[key or ""] = n + 1
            return texts[min(n, len(texts) - 1)]

        return answer

    return factory


_ATTEMPT = pa.list_(pa.struct([("attempt_number", pa.int64()), ("status", pa.string()), ("will_retry", pa.bool_()), ("generation_ms", pa.float64()), ("errors", pa.list_(pa.string())), ("raw_text", pa.string())]))
_DDL = "id string, success boolean, data string, attempts array<struct<attempt_number:long,status:string,will_retry:boolean,generation_ms:double,errors:array<string>,raw_text:string>>, generation_ms double, validation_ms double, completed_utc string"


def generate(prompts: DataFrame, factory: Factory, schema: Schema = CANDIDATE, retry: Retry = Retry(), id_col: str = "id", prompt_col: str = "prompt", workers: int | None = None, give_up: int | None = None) -> DataFrame:
    """(id, success, data as JSON, attempts, generation_ms, validation_ms, completed_utc); one failure doesn't touch other rows.

    workers: partitions that call the model at once, by default as they come. give_up: a task whose calls failed so many times in a row
    asks no more, and what it didn't ask has no row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, failed = factory(), 0
        for batch in batches:
            ids, asked = (batch.column(k).to_pylist() for k in (0, 1))
            got, done = [], []
            for prompt in asked:
                if give_up is not None and failed >= give_up:
                    break
                got.append(run_with_retry(prompt or "", schema, model, retry))
                failed = 0 if got[-1].success or got[-1].attempts[-1]["raw_text"] else failed + 1
                done.append(datetime.now(timezone.utc).isoformat())
            data = [None if x.data is None else json.dumps(x.data, sort_keys=True, ensure_ascii=False) for x in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[: len(got)], pa.string()), pa.array([x.success for x in got], pa.bool_()), pa.array(data, pa.string()), pa.array([x.attempts for x in got], _ATTEMPT), pa.array([x.generation_ms for x in got], pa.float64()), pa.array([x.validation_ms for x in got], pa.float64()), pa.array(done, pa.string())],
                names=["id", "success", "data", "attempts", "generation_ms", "validation_ms", "completed_utc"],
            )

    rows = prompts.select(F.col(id_col).cast("string").alias("id"), F.col(prompt_col).alias("prompt"))
    return (rows.repartition(workers) if workers else rows).mapInArrow(run, _DDL)


@dataclass(frozen=True)
class Settings:
    """What a run is done with; part of every record."""

    model: str = "replay"
    model_version: str = ""
    prompt_version: str = "1"
    seed: int | None = 42
    temperature: float = 0.7
    top_p: float = 0.9
    max_tokens: int = 128


def audit_records(generated: DataFrame, units: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Records of a query generator. A valid answer that leaks names of its unit fails and isn't tried again; its text is
    kept in the attempts alone. units: (id, repository, file_path, symbol)."""
    from .runs import classify_failure

    d = generated.join(units.select("id", "repository", "file_path", "symbol"), "id")
    answer = F.from_json("data", "query string, query_style string, query_intent string")
    d = d.withColumn("a", answer)
    leaks = F.when(F.col("success"), X.leak_violations(F.col("a.query"), F.col("repository"), F.col("file_path"), F.col("symbol"))).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("leaks", leaks).withColumn("valid", F.col("success")).withColumn("ok", F.col("success") & (F.size("leaks") == 0))
    last = F.try_element_at("attempts", F.lit(-1))
    error = F.get(last["errors"], 0)
    category = F.when(~F.col("ok"), classify_failure(F.size("leaks") > 0, F.size("attempts"), last["status"], error))
    blank = lambda c: F.when(F.col("ok"), F.col(f"a.{c}")).otherwise("").alias(c)
    return d.select(
        F.col("id").alias("code_unit_id"), X.candidate_id(F.col("id")).alias("candidate_id"), blank("query"), blank("query_style"), blank("query_intent"),
        F.lit(s.model).alias("model"), F.lit(s.model_version).alias("model_version"), F.lit(s.prompt_version).alias("prompt_version"), F.lit(s.seed).cast("long").alias("seed"), F.lit(s.temperature).alias("temperature"), F.lit(s.top_p).alias("top_p"),
        F.lit(s.max_tokens).cast("long").alias("max_tokens"), F.size("attempts").cast("long").alias("attempt_count"), "attempts", "generation_ms", "validation_ms", F.col("valid").alias("validation_passed"), (F.col("valid") & (F.size("leaks") == 0)).alias("leakage_passed"),
        F.col("leaks").alias("leakage_violations"), F.col("ok").alias("success"), category.alias("failure_category"), F.when(~F.col("ok"), F.coalesce(F.nullif(F.array_join("leaks", "; "), F.lit("")), error)).alias("failure_reason"), "completed_utc",
    )


def semantic_labels(generated: DataFrame, version: str = "1") -> DataFrame:
    """Labels of the units whose answer was valid."""
    a = F.from_json("data", "description string, summary string, concepts array<string>, input_types array<string>, output_type string, side_effects array<string>")
    return generated.filter("success").select(F.col("id").alias("code_unit_id"), a.alias("a"), F.lit("model_generated").alias("created_by"), F.lit(version).alias("label_version")).select("code_unit_id", "a.*", "created_by", "label_version")
