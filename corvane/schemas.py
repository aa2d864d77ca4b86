"""Tables of the library as StructTypes, and their closed domains."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
SPLITS = ("train", "validation", "test")
SYMBOL_TYPES = ("function", "method")
LANGUAGES = ("python",)
RELEVANCE = {"direct_match": 1.0, "highly_relevant": 0.8, "related": 0.5, "not_relevant": 0.0}
CREATED_BY = ("human", "model_generated", "hybrid")
QUERY_STYLES = ("natural", "technical", "verbose", "concise")
DIFFICULTIES = ("easy", "medium", "hard")
#: What a query generator may see of a unit; anything else would give the answer away.
PERMITTED = ("source_code", "docstring", "symbol_type", "class_name", "module_docstring", "imports", "parent_methods")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CONTEXT = _struct(class_name=S, module_docstring=S, imports=T.ArrayType(S), parent_methods=T.ArrayType(S))
CODE_UNIT = _struct(
    repository=S, language=S, file_path=S, symbol=S, symbol_type=S, source_code=S, context=CONTEXT, source_url=S,
    is_public=B, docstring=S, source_file_lines=L, content_hash=S, extracted_at=S,
)
PERSISTED_UNIT = T.StructType([T.StructField("id", S), *CODE_UNIT.fields, T.StructField("split", S)])
ATTEMPT = _struct(attempt_number=L, status=S, will_retry=B, generation_ms=D, errors=T.ArrayType(S), raw_text=S)
AUDIT = _struct(
    code_unit_id=S, candidate_id=S, query=S, query_style=S, query_intent=S, model=S, model_version=S, prompt_version=S,
    seed=L, temperature=D, top_p=D, max_tokens=L, attempt_count=L, attempts=T.ArrayType(ATTEMPT), generation_ms=D, validation_ms=D,
    validation_passed=B, leakage_passed=B, leakage_violations=T.ArrayType(S), success=B, failure_category=S, failure_reason=S, completed_utc=S,
)
#: Columns whose values must agree among all successes of a unit.
METHOD = ("model", "model_version", "prompt_version", "seed", "temperature", "top_p", "max_tokens")
PAYLOAD = ("code_unit_id", "candidate_id", "query", "query_style", "query_intent")
LABEL = _struct(code_unit_id=S, description=S, summary=S, concepts=T.ArrayType(S), input_types=T.ArrayType(S), output_type=S, side_effects=T.ArrayType(S), created_by=S, label_version=S)
QUERY_CASE = _struct(id=S, query=S, query_style=S, query_intent=S, relevant_code_units=T.ArrayType(S), related_concepts=T.ArrayType(S), split=S, difficulty=S, created_at=S)
QREL = _struct(query_id=S, code_unit_id=S, relevance_score=D, relevance_label=S, explanation=S)
REPOSITORY = _struct(id=S, name=S, url=S, commit=S, base_url=S, license=S, description=S, split=S)
MODEL_INFO = _struct(name=S, parameter_count=S, quantization=S, size_bytes=L, modified_at=S)
