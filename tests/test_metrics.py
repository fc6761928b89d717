"""Errors, gates and scalar expressions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelgate.functions import (
    last_segment,
    location,
    parent_path,
    prefixed,
    replace_text,
    workspace_id,
)
from panelgate.operators import metrics


def pairs(spark, rows):
    return spark.createDataFrame(rows, "y double, y_hat double")


def scores(spark, rows):
    return spark.createDataFrame(rows, "name string, mse1 double, mse2 double")


def outcomes(df):
    return dict(df.select("name", "outcome").collect())


def test_mse(spark):
    assert metrics.mse(pairs(spark, [(1.0, 2.0), (3.0, 0.0)])).collect()[0].mse == 5.0


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_mse_refuses_missing_and_infinite_values(spark, bad):
    for row in ((1.0, bad), (bad, 1.0)):
        with pytest.raises(PySparkException):
            metrics.mse(pairs(spark, [(1.0, 1.0), row])).collect()


def test_mse_of_nothing_is_an_error(spark):
    with pytest.raises(PySparkException):
        metrics.mse(pairs(spark, [])).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.floats(-1e3, 1e3), st.floats(-1e3, 1e3)), min_size=1, max_size=20))
def test_mse_is_never_negative_and_zero_on_itself(spark, rows):
    df = pairs(spark, rows)
    assert metrics.mse(df).collect()[0].mse >= 0
    assert metrics.mse(df, y_hat="y").collect()[0].mse == 0


CASES = [
    ("equal", 100.0, 100.0),
    ("close", 100.0, 100.9),
    ("edge", 100.0, 101.0),
    ("worse", 100.0, 50.0),
    ("better", 100.0, 200.0),
    ("zero", 0.0, 1.0),
]


def test_validation_is_strict_and_fails_on_a_zero_base(spark):
    gate = metrics.validate_pair(scores(spark, CASES))
    assert outcomes(gate) == {
        "equal": "passed", "close": "passed", "edge": "failed",
        "worse": "failed", "better": "failed", "zero": "failed",
    }
    with pytest.raises(metrics.GateFailed):
        metrics.assert_valid(gate)
    metrics.assert_valid(gate.filter("outcome = 'passed'"))


def test_monitoring_outcomes(spark):
    assert outcomes(metrics.monitor_pair(scores(spark, CASES))) == {
        "equal": "similar", "close": "similar", "edge": "better",
        "worse": "worse", "better": "better", "zero": "undefined",
    }


def value(spark, column, **fields):
    row = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in fields))
    return row.select(column).collect()[0][0]


def test_names_and_paths(spark):
    assert value(spark, workspace_id("w"), w="workspace_a_b") == "a"
    assert value(spark, workspace_id("w"), w=None) is None
    with pytest.raises(PySparkException):
        value(spark, workspace_id("w"), w="workspace")
    assert value(spark, parent_path("p"), p="s3a://x/m/run") == "s3a://x/m"
    assert value(spark, parent_path("p"), p="run") == "run"
    assert value(spark, parent_path("p"), p="a/b/\n") == "a/b"
    assert value(spark, last_segment("p"), p="s3a://x/m/run") == "run"
    assert value(spark, last_segment("p"), p="run") == "run"
    assert value(spark, last_segment("p"), p="a/") == ""
    assert value(spark, prefixed("p", "sp_"), p="m") == "sp_m"
    assert value(spark, replace_text("p", "dbfs:", "/dbfs"), p="dbfs:/a.b") == "/dbfs/a.b"
    assert value(spark, replace_text("p", ".", "_"), p="a.b") == "a_b"


def test_location_needs_every_part(spark):
    assert value(spark, location(F.lit("base"), "a", "b"), a="x", b="y") == "base/x/y"
    with pytest.raises(PySparkException):
        value(spark, location(F.lit("base"), "a", "b"), a="x", b=None)
