"""One model from training to monitoring."""

import datetime

import pytest
from pyspark.sql import functions as F

from panelgate import sinks, sources
from panelgate.operators.metrics import GateFailed
from panelgate.plans import steps
from panelgate.schemas import EXPORT_LEDGER, IMPORT_LEDGER, MODEL_VERSIONS

NAMES = ["Daily ICU occupancy", "Daily hospital occupancy", "Weekly new hospital admissions"]
SMALL = {"maxIter": 2, "maxDepth": 2}


@pytest.fixture(scope="module")
def long(spark):
    day = F.date_add(F.lit("2021-01-01").cast("date"), F.col("id").cast("int"))
    return spark.range(0, 400, 1, 4).select(
        F.lit("USA").alias("iso_code"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.explode(F.array(*[F.lit(n) for n in NAMES])).alias("indicator"),
        (F.col("id") % 60).cast("string").alias("value"),
    )


def stages(spark, path, name):
    rows = sources.read_published(spark, path).filter(F.col("name") == name).collect()
    return {r.version: r.stage for r in rows}


def promote_by_hand(spark, path, name):
    versions = sources.read_published(spark, path)
    staged = (F.col("name") == name) & (F.col("stage") == "Staging")
    sinks.publish(
        versions.withColumn("stage", F.when(staged, "Production").otherwise(F.col("stage"))), path
    )


def test_train_validate_export_import_predict_monitor(spark, long, tmp_path):
    spark.sql(f"CREATE DATABASE steps_test LOCATION '{tmp_path}/db'")
    registry, root = str(tmp_path / "versions"), str(tmp_path / "models")
    exports, imports = str(tmp_path / "exports"), str(tmp_path / "imports")
    sinks.ensure_ledger(spark, registry, MODEL_VERSIONS)

    def train(name, run_id, **params):
        return steps.train(
            long, registry, root, name, run_id, "steps_test.run_values",
            database="steps_test", **params,
        )

    assert train("m", "r1", **SMALL) == "1"
    assert train("sp_m", "r2", **SMALL) == "1"
    assert spark.table("steps_test.final_train_m_1").count() == 400
    values = spark.table("steps_test.run_values")
    assert {(r.run_id, r.kind, r.key) for r in values.collect()} == {
        (run, kind, key) for run in ("r1", "r2")
        for kind, key in (("param", "n_estimators"), ("metric", "accuracy"))
    }

    table = spark.table("steps_test.final_train_m_1")
    gate = steps.validate(spark, registry, root, table, ("m", "1"), "sp_m")
    assert gate.head()["outcome"] == "passed"
    assert stages(spark, registry, "sp_m") == {"1": "Staging"}

    train("sp_m", "r3", maxIter=1, maxDepth=1)
    with pytest.raises(GateFailed):
        steps.validate(spark, registry, root, table, ("m", "1"), "sp_m")
    assert stages(spark, registry, "sp_m") == {"1": "Staging", "2": "None"}

    promote_by_hand(spark, registry, "sp_m")
    for _ in range(2):
        ledger = steps.export(spark, registry, exports, "w", "s3a://base")
        assert [tuple(r)[:4] for r in ledger.collect()] == [
            ("workspace_w", "sp_m", "1", "s3a://base/mlflowexportmodels/workspace_w/sp_m/r2")
        ]

    imported = "imported_sp_m"
    for _ in (1, 2):
        ledger = steps.import_newest(spark, exports, registry, imports)
        assert ledger.count() == 1
    assert stages(spark, registry, imported) == {"1": "Production"}
    versions = sources.read_published(spark, registry)
    second = (F.col("name") == "sp_m") & (F.col("version") == "2")
    sinks.publish(
        versions.withColumn("stage", F.when(second, "Production").otherwise(F.col("stage"))), registry
    )
    steps.export(spark, registry, exports, "w", "s3a://base")
    for _ in (1, 2):
        # The registry is shared here, so the imported model was exported as well.
        assert steps.import_due(spark, exports, registry, imports).count() == 3
    assert stages(spark, registry, imported) == {"1": "Archived", "2": "Production"}

    with pytest.raises(GateFailed):
        steps.monitor_model(spark, registry, root, "m")
    versions = sources.read_published(spark, registry)
    for version in ("1", "2"):
        model = steps.models.load_version(versions, root, "sp_m", version)
        steps.models.save_version(model, root, imported, version)
        sinks.save_example(table, steps.example_path(root, imported, version))
        steps.models.save_contract(table.select(*steps.ft.FEATURES), root, imported, version)
    scored = steps.predict_example(spark, registry, root, imported)
    assert scored.columns == table.columns + ["y_hat"]
    assert scored.count() == 400
    assert steps.monitor_model(spark, registry, root, imported).head()["outcome"] == "worse"
    changed = table.withColumn("quarter", F.col("quarter").cast("string"))
    sinks.save_example(changed, steps.example_path(root, imported, "2"))
    with pytest.raises(ValueError, match="quarter: expected int, found string"):
        steps.predict_example(spark, registry, root, imported)


def test_all_due_exports_are_imported_once(spark, tmp_path):
    registry, exports, imports = (str(tmp_path / n) for n in ("versions", "exports", "imports"))
    sinks.ensure_ledger(spark, registry, MODEL_VERSIONS)
    with pytest.raises(GateFailed):
        steps.export(spark, registry, exports, "w", "s3a://base")
    rows = [(n, v, "Production", "", f"r{n}{v}") for n, v in (("a", "9"), ("a", "10"), ("b", "1"), ("c", "007"))]
    sinks.append_to_ledger(spark, registry, spark.createDataFrame(rows, MODEL_VERSIONS))
    assert steps.export(spark, registry, exports, "w", "s3a://base").count() == 3
    for _ in (1, 2):
        ledger = steps.import_due(spark, exports, registry, imports)
        assert sorted((r.imported_model_name, r.imported_model_version) for r in ledger.collect()) == [
            ("imported_a", "10"), ("imported_b", "1"), ("imported_c", "007")
        ]
    for name in "abc":
        assert stages(spark, registry, f"imported_{name}") == {"1": "Production"}


def exported(*rows):
    return [
        (f"workspace_{w}", m, v, f"s3a://b/{m}/r{w}{m}{v}", datetime.datetime(2023, 1, day))
        for w, m, v, day in rows
    ]


def test_workspaces_with_one_model_name_are_imported_in_order(spark, tmp_path):
    registry, exports, imports = (str(tmp_path / n) for n in ("versions", "exports", "imports"))
    sinks.ensure_ledger(spark, registry, MODEL_VERSIONS)
    rows = exported(("y", "m", "3", 2), ("x", "m", "1", 1), ("x", "m", "2", 3), ("x", "k", "1", 1))
    sinks.publish(spark.createDataFrame(rows, EXPORT_LEDGER), exports)
    for _ in (1, 2):
        assert steps.import_due(spark, exports, registry, imports).count() == 3
    versions = sources.read_published(spark, registry).collect()
    assert sorted((r.name, r.version, r.stage, r.run_id) for r in versions) == [
        ("imported_k", "1", "Production", "rxk1"),
        ("imported_m", "1", "Archived", "rym3"),
        ("imported_m", "2", "Production", "rxm2"),
    ]
    more = spark.createDataFrame(exported(("z", "m", "9", 4)), EXPORT_LEDGER)
    sinks.append_to_ledger(spark, exports, more)
    assert steps.import_due(spark, exports, registry, imports).count() == 4
    assert stages(spark, registry, "imported_m") == {"1": "Archived", "2": "Archived", "3": "Production"}


def test_imports_that_only_the_ledger_has_are_registered(spark, tmp_path):
    registry, exports, imports = (str(tmp_path / n) for n in ("versions", "exports", "imports"))
    sinks.ensure_ledger(spark, registry, MODEL_VERSIONS)
    ledger = spark.createDataFrame(exported(("x", "m", "1", 1)), EXPORT_LEDGER)
    sinks.publish(ledger, exports)
    sinks.ensure_ledger(spark, imports, IMPORT_LEDGER)
    done = steps.stamp(steps.as_imported(ledger), "2023-02-01")
    sinks.append_to_ledger(spark, imports, done)
    for _ in (1, 2):
        assert steps.import_due(spark, exports, registry, imports).count() == 1
        assert stages(spark, registry, "imported_m") == {"1": "Production"}


def test_exports_to_import_are_found_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(place):
        made.add(1)
        return place

    exports = spark.range(0, 40, 1, 2).select(
        F.lit("workspace_1_b").alias("from_workspace"),
        F.concat(F.lit("m"), F.col("id") % 5).alias("exported_model_name"),
        F.col("id").cast("string").alias("exported_model_version"),
        counted(F.concat(F.lit("s3a://x/m/r"), F.col("id"))).alias("external_location"),
        F.timestamp_seconds("id").alias("timestamp"),
    )
    versions = spark.createDataFrame([], MODEL_VERSIONS)
    ledger = spark.createDataFrame([], IMPORT_LEDGER)
    plan = steps._importing(exports, "2023-05-01 12:00:00")
    changes, rows = plan(versions, ledger)
    imported = changes.collect()
    assert rows.count() == 40 and len(imported) == 40
    assert sorted(r.version for r in imported if r.stage == "Production") == ["8"] * 5
    assert made.value == 40
    changes, rows = plan(spark.createDataFrame(imported, MODEL_VERSIONS), ledger)
    assert changes.columns == versions.columns and changes.isEmpty()
    assert rows.count() == 40
