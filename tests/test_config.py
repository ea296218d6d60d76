import pytest

from driftwell.functions.expressions import parse_duration
from driftwell.plans.config import FUNCTIONS, Detector, read_analysis, read_job
from driftwell.streaming.jobs import control_message


def test_durations():
    assert [parse_duration(x) for x in ("15m", "1h", "2d", "90", 7, "1w")] == [900, 3600, 172800, 90, 7, 604800]
    with pytest.raises(ValueError):
        parse_duration("soon")


def test_function_grammar():
    assert FUNCTIONS["high_nzc"].name == "high_non_zero_count" and FUNCTIONS["low_avg"].tail == "low"
    for bad in (dict(function="nope"), dict(function="mean"), dict(function="count", field_name="x"), dict(function="rare"), dict(function="freq_rare", by="a"), dict(function="nzc", over="b"), dict(function="count", by="a", over="a")):
        with pytest.raises(ValueError):
            Detector(**bad)


def test_job():
    job = read_job(
        '{"analysis_config": {"bucket_span": "15m", "influencers": ["host"], "detectors": [{"function": "mean", "field_name": "v", "by_field_name": "b",'
        ' "custom_rules": [{"actions": ["skip_result"], "conditions": [{"applies_to": "actual", "operator": "lt", "value": 3}], "scope": {"b": {"filter_type": "exclude", "items": ["x*"]}}}]}]}}'
    )
    assert job.bucket_span == 900 and job.detectors[0].rules[0].conditions[0].value == 3.0
    with pytest.raises(ValueError):
        read_job({"detectors": [{"function": "count", "colour": 1}]})
    with pytest.raises(ValueError):
        read_job({"detectors": []})


def test_analysis():
    assert read_analysis({"analysis": {"name": "outlier_detection", "parameters": {"n_neighbors": 3}}})[1]["n_neighbors"] == 3
    for bad in ({"name": "x"}, {"name": "regression"}, {"name": "outlier_detection", "parameters": {"y": 1}}):
        with pytest.raises(ValueError):
            read_analysis({"analysis": bad})


def test_control_messages():
    assert control_message("t1000") == ("advance_time", {"time": 1000}) and control_message("i10 20") == ("interim_results", {"start": 10, "end": 20})
    assert control_message('p{"duration": 5}') == ("forecast", {"duration": 5}) and control_message("w") == ("persist", {})
    with pytest.raises(ValueError):
        control_message("q")
