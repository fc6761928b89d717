"""Version tables: lookups, gates and transitions."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from panelgate.operators import versions as mv
from panelgate.operators.metrics import GateFailed
from panelgate.schemas import MODEL_VERSIONS

ROWS = [
    ("a", "9", "Production", "old", "ra9"),
    ("a", "10", "Production", "Already Exported , old description: x", "ra10"),
    ("a", "11", "None", "", "ra11"),
    ("b", "1", "Production", None, "rb1"),
    ("b", "2", "None", "", "rb2"),
    ("c", "3", "Staging", "", "rc3"),
    ("d", "4", "Production", "Exported Already On", "rd4"),
    ("d", "2", "Archived", "", "rd2"),
    ("e", "0", "None", "", "re0"),
    ("f", "5", "Production", "", "rf5"),
    ("f", "4", "Archived", "", "rf4"),
]


@pytest.fixture(scope="module")
def versions(spark):
    return spark.createDataFrame(ROWS, MODEL_VERSIONS)


def records(df):
    return sorted(tuple(row) for row in df.collect())


def test_latest_version_is_numeric_and_zero_is_none(versions):
    assert records(mv.latest_version(versions)) == [("a", "11"), ("b", "2")]
    assert mv.newest_version_of(versions, "a", "Production") == "10"
    with pytest.raises(LookupError):
        mv.newest_version_of(versions, "e")
    with pytest.raises(LookupError):
        mv.newest_version_of(versions, "a", "Staging")


def test_version_that_is_no_number_is_an_error(spark):
    bad = spark.createDataFrame([("a", "7.5", "None", "", "r")], MODEL_VERSIONS)
    with pytest.raises(PySparkException):
        mv.latest_version(bad).collect()


def test_export_candidates(versions):
    found = {r.name: (r.should_export, r.version) for r in mv.export_candidates(versions).collect()}
    assert found == {
        "a": (False, "10"), "b": (True, "1"), "c": (False, "-1000"),
        "d": (True, "4"), "e": (False, "-1000"), "f": (True, "5"),
    }
    other = {r.name: r.should_export
             for r in mv.export_candidates(versions, "Exported Already On").collect()}
    assert other == {"a": True, "b": True, "c": False, "d": False, "e": False, "f": True}


def test_markers_are_case_sensitive(versions):
    assert records(mv.already_exported(versions, "already exported")) == []
    assert [r.run_id for r in mv.already_exported(versions).collect()] == ["ra10"]
    assert mv.not_exported(versions).count() == len(ROWS) - 1


def test_run_ids_come_from_the_newest_of_each_stage(spark, versions):
    asked = spark.createDataFrame([("a", "10"), ("a", "9"), ("d", "2")], "name string, version string")
    assert {(r.name, r.version): r.run_id for r in mv.run_ids(asked, versions).collect()} == {
        ("a", "10"): "ra10", ("a", "9"): None, ("d", "2"): "rd2",
    }


def test_previous_version_is_the_number_below(versions):
    assert records(mv.previous_version(versions)) == [
        ("a", "10", "9", True), ("d", "4", "3", False), ("f", "5", "4", True),
    ]


def test_stage_and_pair_checks(versions):
    assert dict(mv.require_stage(versions).select("name", "ok").collect()) == {
        "a": True, "b": True, "c": False, "d": True, "e": False, "f": True,
    }
    mv.assert_stage(versions, "a")
    mv.assert_two_versions(versions, "a")
    for check in (mv.assert_stage, mv.assert_two_versions):
        with pytest.raises(GateFailed):
            check(versions, "c")
    with pytest.raises(GateFailed):
        mv.assert_two_versions(versions, "b")


def changed(before, after):
    return sorted(set(map(tuple, after.collect())) - set(map(tuple, before.collect())))


def test_transitions_change_only_their_rows(spark, versions):
    gate = spark.createDataFrame(
        [("a", "passed"), ("a", "passed"), ("b", "failed"), ("c", "passed")],
        "name string, outcome string",
    )
    promoted = mv.promote(versions, gate)
    assert promoted.count() == len(ROWS)
    assert changed(versions, promoted) == [
        ("a", "11", "Staging", "Tests passed, ready to transition to 'Production'", "ra11")
    ]
    incoming = spark.createDataFrame([("a",), ("a",), ("c",), ("z",)], "name string")
    archived = mv.archive_previous(versions, incoming)
    assert archived.count() == len(ROWS)
    assert [r[:3] for r in changed(versions, archived)] == [("a", "10", "Archived")]
    exported = spark.createDataFrame([("b", "1"), ("b", "1")], "name string, version string")
    marked = mv.mark_exported(versions, exported)
    assert marked.count() == len(ROWS)
    assert [r[3] for r in changed(versions, marked)] == ["Already Exported , old description: "]


def test_register_takes_the_next_number(spark, versions):
    runs = spark.createDataFrame([("a", "new"), ("z", "first")], "name string, run_id string")
    assert records(mv.register(versions, runs)) == [
        ("a", "12", "None", "", "new"), ("z", "1", "None", "", "first"),
    ]
    assert mv.register(versions, runs).columns == versions.columns
    twice = runs.union(runs)
    with pytest.raises(PySparkException):
        mv.register(versions, twice).collect()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 9), st.integers(0, 1000))
def test_latest_version_ignores_order_and_partitions(spark, parts, seed):
    rows = list(ROWS)
    random.Random(seed).shuffle(rows)
    shuffled = spark.createDataFrame(rows, MODEL_VERSIONS).repartition(parts)
    assert records(mv.latest_version(shuffled, "Production")) == [
        ("a", "10"), ("b", "1"), ("d", "4"), ("f", "5"),
    ]


def test_runs_of_one_model_get_numbers_in_their_order(spark, versions):
    runs = [("a", f"r{i % 7}", i // 7) for i in range(50)] + [("z", None, 1), ("z", "x", 0), ("q", "q", 5)]
    frame = spark.createDataFrame(runs, "name string, run_id string, at int").repartition(4)
    found = mv.register(versions, frame, ["at"])
    assert found.columns == versions.columns
    rows = {(r.name, int(r.version)): r.run_id for r in found.collect()}
    expected = sorted(runs[:50], key=lambda r: (r[2], r[1]))
    assert rows == {
        **{("a", 12 + i): r[1] for i, r in enumerate(expected)},
        ("z", 1): "x", ("z", 2): None, ("q", 1): "q",
    }
    unnamed = spark.createDataFrame([(None, "r", 1)], "name string, run_id string, at int")
    with pytest.raises(PySparkException, match="run without a model"):
        mv.register(versions, unnamed, ["at"]).collect()


def shuffles(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hash")


def test_newest_rows_need_one_shuffle(spark, versions, tmp_path):
    versions.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    for found in (mv.latest_per_stage(stored), mv.export_candidates(stored)):
        assert shuffles(found) == 1
        assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_equal_version_numbers_give_one_row(spark):
    twice = spark.createDataFrame(
        [("a", "7", "Production", "", "r1"), ("a", "007", "Production", "", "r2")], MODEL_VERSIONS
    )
    for parts in (1, 3):
        assert [r.run_id for r in mv.latest_per_stage(twice.repartition(parts)).collect()] == ["r2"]
