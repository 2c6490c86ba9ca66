"""Strict judgment parsing against Python's re + json on noisy text (JSN-1..4)."""

import json
import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelscore.config import METRICS
from panelscore.functions.judgment import parse_judgments


def python_reference(text):
    """What a Python re + json judge parser yields: (status, row scores, numeric scores)."""
    m = re.search(r"{.*}", text, re.DOTALL)
    if not m:
        return "no_json", None, None
    try:
        obj = json.loads(m.group())
    except Exception:
        return "bad_json", None, None
    if not obj:
        return "empty", None, None
    rows, nums = {}, {}
    for k in METRICS:
        if k not in obj:
            rows[k], nums[k] = 0.5, None
            continue
        v = obj[k]
        nums[k] = float(v) if isinstance(v, (int, float)) else None
        if v is None:
            rows[k] = None
        elif isinstance(v, (bool, int, float)):
            rows[k] = float(v)
        elif isinstance(v, str):
            try:
                f = float(v)
                rows[k] = None if math.isnan(f) else f
            except ValueError:
                rows[k] = None
        else:
            rows[k] = None
    return "ok", rows, nums


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, raw_text string")
    out = parse_judgments(df, keep=["id"]).orderBy("id").collect()
    return out


def check(spark, texts):
    for r, t in zip(run(spark, texts), texts):
        status, rows, nums = python_reference(t)
        assert r["status"] == status, t
        if status != "ok":
            assert all(r[m] is None for m in METRICS)
            continue
        for m in METRICS:
            assert r[m] == rows[m], (t, m)
            assert r[f"num_{m}"] == nums[m], (t, m)


def test_fault_classes(spark):
    texts = [
        "I cannot score this.",
        'Scores: {"helpfulness": 0.5, "notes": "}',
        'Here: {"correctness": 0.2, "helpfulness": 0.9} Thanks.',
        '{"correctness": null, "clarity": true, "coherence": "0.8", "accuracy": "high"}',
        "{}",
        '{"helpfulness": 1} or {"helpfulness": 2}',
        '{"helpfulness": 1}, {"helpfulness": 2}',
        'text {"helpfulness": 0.25,\n "tone_score": 1, "helpfulness": 0.75} more }',
        '{"helpfulness": [1], "relevance": {"x": 1}, "completeness": false}',
        '{"a": {"b": 1}}',
    ]
    check(spark, texts)


keys = st.sampled_from(METRICS + ["reasoning", "notes", "extra"])
values = st.one_of(
    st.none(), st.booleans(), st.integers(-5, 5),
    st.floats(allow_nan=False, allow_infinity=False, width=32).map(lambda x: round(x, 3)),
    st.sampled_from(["0.8", "x", "", "nan", "1e-2"]),
)
objects = st.dictionaries(keys, values, max_size=6).map(json.dumps)
noise = st.sampled_from(["", "Sure: ", "Result\n", "} ", "{ broken ", " thanks", " {", " or {\"x\": 1}"])


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(noise, objects, noise), min_size=5, max_size=15))
def test_property_against_python(spark, parts):
    check(spark, [a + o + b for a, o, b in parts])


def test_issue_kinds(spark):
    from panelscore.functions.judgment import judgment_issues

    df = spark.createDataFrame([(1, '{"helpfulness": "high", "correctness": [1], "coherence": "0.5", '
                                    '"tone_score": null, "accuracy": false, "relevance": 1, "completeness": 0.5}'),
                                (2, "no json")], "id long, raw_text string")
    got = {(r["metric"], r["kind"]) for r in judgment_issues(df, keep=["id"]).collect()}
    assert got == {("helpfulness", "text"), ("correctness", "other"), ("coherence", "numeric_string"),
                   ("tone_score", "null"), ("accuracy", "boolean"), ("clarity", "missing")}


def test_block_extraction_is_linear_and_exact(spark):
    import time

    texts = ["{" * 100_000 + " no close", "} before {", "x {a} y } z", "{}}", "{" * 50_000 + "}"]
    t = time.time()
    check(spark, texts)
    assert time.time() - t < 60
