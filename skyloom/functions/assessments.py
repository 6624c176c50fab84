"""Recorded answers of a model: which are valid by their schema, and what they say. No model is called."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Allowed assessments, and the fields of each task with their largest length (a list holds 20 texts of 500).
PHISHING = ("phishing", "not_phishing", "insufficient_evidence")
CLOAKING = ("supports_cloaking", "does_not_support_cloaking", "insufficient_evidence")
FIELDS = {
    "phishing": {"assessment": PHISHING, "key_indicators": list, "explanation": 2000}, "cloaking": {"assessment": CLOAKING, "alternative_explanations": list, "evidence_refs": list, "explanation": 3000}, "code": {"code": 20_000},
}
MOST_CHARS = 100_000


def _object(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("duplicate_json_key")
    return dict(pairs)


def _constant(name: str):
    raise ValueError(f"non_finite_json:{name}")


def _fits(value, rule) -> bool:
    if rule is list:
        return isinstance(value, list) and len(value) <= 20 and all(isinstance(x, str) and len(x) <= 500 for x in value)
    return isinstance(value, str) and (value in rule if isinstance(rule, tuple) else len(value) <= rule)


def problem(answer: str | None, task: str) -> str | None:
    """Why an answer is not used, or None: whole JSON, no key twice, no NaN, exactly the task's fields, each of its kind."""
    if answer is None or len(answer) > MOST_CHARS:
        return "invalid_response_type_or_size"
    try:
        value = json.loads(answer, parse_constant=_constant, object_pairs_hook=_object)
    except ValueError as e:
        return str(e) if "json" in str(e) else "not_json"
    fields = FIELDS[task]
    if not isinstance(value, dict) or set(value) != set(fields):
        return "wrong_fields"
    wrong = [k for k, rule in fields.items() if not _fits(value[k], rule)]
    return f"invalid_field:{wrong[0]}" if wrong else None


def validated(task: str):
    """A column function of answers: status (valid or invalid_or_unavailable), reason and the text that counts."""
    said = "code" if task == "code" else "assessment"
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("status", "reason", "value")])

    @F.arrow_udf(kind)
    def check(answers: pa.Array) -> pa.Array:
        rows = []
        for a in answers.to_pylist():
            why = problem(a, task)
            rows.append({"status": "invalid_or_unavailable" if why else "valid", "reason": why, "value": None if why else json.loads(a)[said]})
        return pa.array(rows, pa.struct([(n, pa.string()) for n in ("status", "reason", "value")]))

    return check
