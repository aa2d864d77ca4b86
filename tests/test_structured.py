"""JSON in answers, schemas, retry and audit records."""

import json

import pytest

from corvane.functions import prompts, structured
from corvane.functions.structured import CANDIDATE, ConstraintViolationError, Field, MalformedJSONError, MissingFieldError, Schema, TypeMismatchError, corrective_prompt, extract_json, native_json, validate, validated
from corvane.operators import generate
from corvane.operators.generate import Retry, audit_records, replay, run_with_retry

GOOD = json.dumps({"query": "sum of two numbers", "query_style": "natural", "query_intent": "find"})


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": 1}', {"a": 1}), ("[1, 2]", [1, 2]), ("3", 3), ('  "x" ', "x"), ('text ```json\n{"a": 1}\n``` more', {"a": 1}), ("```\n[1]\n```", [1]),
        ('Here: {"a": {"b": "}"}} and {"c": 2}', {"a": {"b": "}"}}), ('{"a": "\\"}"} tail', {"a": '"}'}), ("{bad} [1, 2]", [1, 2]), ("{ [3]", [3]), ('```json\nno\n``` {"a": 2}', {"a": 2}),
    ],
)
def test_extract(raw, want):
    assert extract_json(raw) == want


@pytest.mark.parametrize("raw", ["", "  ", "prose", '{"a": 1', "{bad}", "{x} {}"])
def test_malformed(raw):
    with pytest.raises(MalformedJSONError):
        extract_json(raw)


def test_schema():
    s = Schema((Field("name", "str", least=1), Field("count", "int", least=0), Field("tags", "list", required=False), Field("share", "float", required=False, least=0, most=1)))
    assert validate('{"name": "a", "count": "3", "extra": 1, "share": "0.5"}', s) == ({"name": "a", "count": 3, "share": 0.5}, [])
    kinds = lambda raw: [type(e) for e in validate(raw, s)[1]]
    assert kinds("{}") == [MissingFieldError, MissingFieldError]
    assert kinds('{"name": "a", "count": "x"}') == [TypeMismatchError]
    assert kinds('{"name": "", "count": -1, "tags": [1], "share": 2}') == [ConstraintViolationError] * 4
    assert kinds("[1]") == [ConstraintViolationError] and kinds("x") == [MalformedJSONError]
    assert corrective_prompt([]) == "" and "- MissingFieldError: name" in corrective_prompt(validate("{}", s)[1])


def test_columns(spark):
    rows = [(1, GOOD), (2, f"```json\n{GOOD}\n```"), (3, f"so {GOOD}."), (4, None), (5, "{}")]
    df = spark.createDataFrame(rows, "id long, raw string")
    got = {r.id: (r.answer.valid, len(r.answer.errors)) for r in validated(df, "raw", CANDIDATE).collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (True, 0), 4: (False, 1), 5: (False, 3)}
    native = {r.id: r.q for r in df.select("id", native_json(df.raw, "query string")["query"].alias("q")).collect()}
    assert native[1] == native[2] == "sum of two numbers" and native[3] is None
    assert structured.canonical_json('{"b": 1, "a": 2}') == '{"a": 2, "b": 1}'


def test_retry():
    out = run_with_retry("p", CANDIDATE, replay({"p": ["x", "{}", GOOD]})())
    assert out.success and [a["will_retry"] for a in out.attempts] == [True, True, False] and out.attempts[1]["errors"][0].startswith("MissingFieldError")
    assert len(run_with_retry("p", CANDIDATE, replay({"p": ["x"]})()).attempts) == 3
    assert len(run_with_retry("p", CANDIDATE, replay({"p": ["x"]})(), Retry(kinds=(MissingFieldError,))).attempts) == 1
    asked = []

    def fails(prompt):
        asked.append(prompt)
        if len(asked) == 2:
            raise TimeoutError("late")
        return "x"

    out = run_with_retry("p", CANDIDATE, fails)
    assert [a["status"] for a in out.attempts] == ["failed", "failed"] and out.attempts[1]["errors"] == ["TimeoutError: late"]
    assert asked[0] == "p" and asked[1].startswith("p\n\n")
    with pytest.raises(ValueError):
        Retry(attempts=0)


def test_audit(spark):
    units = spark.createDataFrame([("u1", "repo", "a/b.py", "add"), ("u2", "repo", "a/b.py", "zzz"), ("u3", "repo", "c", "q"), ("u4", "repo", "c", "q")], "id string, repository string, file_path string, symbol string")
    leak = json.dumps({"query": "see repo a/b.py", "query_style": "natural", "query_intent": "find"})
    factory = replay({"p1": [GOOD], "p2": [leak], "p3": ["x", "{}"]})
    asked = spark.createDataFrame([("u1", "p1"), ("u2", "p2"), ("u3", "p3"), ("u4", "none")], "id string, prompt string")
    made = generate.generate(asked, factory)
    got = {r.code_unit_id: r for r in audit_records(made, units).collect()}
    assert got["u1"].success and got["u1"].query == "sum of two numbers" and got["u1"].candidate_id == "candidate_u1" and got["u1"].failure_category is None
    assert not got["u2"].success and got["u2"].query == "" and got["u2"].failure_category == "leakage" and got["u2"].validation_passed and {"repository", "file path", r"\.py\b"} <= set(got["u2"].leakage_violations) and got["u2"].attempt_count == 1
    assert got["u3"].failure_category == "missing_field" and got["u3"].attempt_count == 3
    assert got["u4"].failure_category == "provider_or_model_error" and got["u4"].attempt_count == 1


def test_prompts(spark):
    row = ("u", "r", "secret/path.py", "sym", "function", "def f(): pass", "doc", ("C", None, ["os"], []))
    df = spark.createDataFrame([row], "id string, repository string, file_path string, symbol string, symbol_type string, source_code string, docstring string, context struct<class_name:string,module_docstring:string,imports:array<string>,parent_methods:array<string>>")
    b = prompts.blind(df)
    prompts.assert_blind(b)
    text = b.select(prompts.query_prompt().alias("p")).first().p
    assert "secret" not in text and "Class: C" in text and "Imports: os" in text and "Module:" not in text and "Other methods" not in text
    assert "description" in b.select(prompts.label_prompt().alias("p")).first().p
    with pytest.raises(ValueError):
        prompts.assert_blind(df)
