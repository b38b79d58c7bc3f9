"""Parts without Spark: slices, batches, paths, templates, replies, policies, extraction."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from docmill.config import Config, read_env_file
from docmill.functions import reply as R
from docmill.functions.template import Y2
from docmill.operators.classify import verdict
from docmill.operators.extract import ANALYSE, CLASSIFY
from docmill.operators.provider import CallPolicy, ReplayProvider
from docmill.sources.csvsource import header_names
from docmill.spec import RunSpec, batch_count, slice_bounds


@given(st.integers(0, 50), st.none() | st.integers(-70, 70), st.none() | st.integers(-70, 70))
def test_slice_bounds_are_pythons(n, start, end):
    rows = list(range(n))
    lo, hi = slice_bounds(n, start, end)
    assert rows[lo:hi] == rows[start:end]


@given(st.integers(0, 500), st.integers(1, 70))
def test_batches_partition_the_rows(n, size):
    assert batch_count(n, size) == len(range(0, n, size))


def test_spec_validates_and_anchors():
    spec = RunSpec("'/data/in.csv'", "out.csv", start_row=-3)
    assert spec.input_path == "/data/in.csv" and spec.output_path == "/data/out.csv"
    assert spec.bounds(10) == (7, 10) and spec.batches(10) == 1 and spec.batch_size == 64
    assert RunSpec("/data/in.csv", "/else/out.csv").output_path == "/else/out.csv"
    for bad in ({"batch_size": 0}, {"url_column": ""}, {"input_path": "''"}, {"output_path": ""}):
        with pytest.raises(ValueError):
            RunSpec(**({"input_path": "a", "output_path": "b"} | bad))


def test_config(tmp_path):
    path = tmp_path / "env"
    path.write_text("# note\nA='x'\nexport B=y=z\n\nbroken\n")
    values = read_env_file(str(path))
    assert values == {"A": "x", "B": "y=z"}
    assert Config(values).require("A", "B") == values
    with pytest.raises(KeyError):
        Config({}).require("SURELY_NOT_SET")


def test_template_renders_null_as_unknown():
    assert "Issue: unknown" in Y2.render(url="u", text="t", y1=None)


CASES = [
    ('{"is_annual_report": true, "confidence": "high", "reason": "r"}', "ok", True, "high", "r"),
    ('```json\n{"is_annual_report": false}\n```', "ok", False, "unknown", ""),
    ('```{"is_annual_report": null, "confidence": null}```', "ok", None, None, ""),
    ('{"a": 1} tail', "bad_json", None, "failed", "API call failed"),
    ("{'a': 1}", "bad_json", None, "failed", "API call failed"),
    ("{}", "empty_object", None, "failed", "API call failed"),
    ("[1]", "not_object", None, "failed", "API call failed"),
    ("null", "not_object", None, "failed", "API call failed"),
    ("", "bad_json", None, "failed", "API call failed"),
    (None, "call_failed", None, "failed", "API call failed"),
    ('{"is_annual_report": "true"}', "bad_type", None, "failed", "API call failed"),
    ('{"is_annual_report": 1}', "bad_type", None, "failed", "API call failed"),
    ('{"is_annual_report": true, "is_annual_report": false}', "ok", False, "unknown", ""),
]


@pytest.mark.parametrize("raw,status,label,sure,why", CASES)
def test_verdict(raw, status, label, sure, why):
    assert verdict(raw) == {"status": status, "is_annual_report": label, "confidence": sure, "classification_reason": why}


def test_decode_accepts_any_object():
    assert R.decode(json.dumps({"Y2": 0})) == ("ok", {"Y2": 0})


def test_policy_retries_and_waits():
    waits, calls = [], []

    class Flaky:
        def complete(self, prompt, question, row):
            calls.append(question)
            if len(calls) < 3:
                raise TimeoutError
            return "fine"

    policy = CallPolicy(tries=8, sleep=waits.append)
    assert policy.call(Flaky(), "p", "q", {}) == "fine" and waits == [2.0, 4.0]
    assert sum(policy.waits()) == 254
    assert CallPolicy(tries=2, sleep=waits.append).call(ReplayProvider("r"), "p", "q", {"r": None}) is None
    assert ReplayProvider("r").complete("p", "Y2", {"r": [("Y2", "two")]}) == "two"


def test_gates_differ_on_blank_pages():
    assert CLASSIFY.wants_ocr([" " * 60]) and not ANALYSE.wants_ocr([" " * 60])
    assert not ANALYSE.wants_ocr([""] * 60) or ANALYSE.wants_ocr([""] * 15)
    assert CLASSIFY.wants_ocr([None, "x" * 49]) and not CLASSIFY.wants_ocr(["x" * 50])
    assert CLASSIFY.text(["a"] * 20) == "a" * 15 and len(ANALYSE.text(["b" * 300_000])) == 300_000


def test_header_names():
    assert header_names([None, "a", "a", "a.1", ""]) == ["Unnamed: 0", "a", "a.1", "a.1.1", "Unnamed: 4"]
