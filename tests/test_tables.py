"""Sources, sinks and ledgers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from panelgate import sinks, sources
from panelgate.operators.ordering import latest_row, latest_run, latest_runs
from panelgate.plans import export_ledger_rows, import_ledger_rows
from panelgate.schemas import EXPORT_LEDGER, IMPORT_LEDGER, MODEL_VERSIONS, RUNS
from panelgate.storage import shared_dir


def records(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    spark.sql(f"CREATE DATABASE tables_test LOCATION '{tmp_path_factory.mktemp('db')}'")
    return "tables_test"


def test_training_table_is_replaced_with_its_schema(spark, database):
    first = spark.createDataFrame([(1, 2.0)], "a int, y double")
    second = spark.createDataFrame([(3.0, "x")], "y double, b string")
    name = sinks.save_training_table(first, "m", "7", database)
    assert name == "tables_test.final_train_m_7"
    sinks.save_training_table(second, "m", "7", database)
    assert spark.table(name).dtypes == second.dtypes
    assert records(spark.table(name)) == [(3.0, "x")]
    with pytest.raises(ValueError):
        sinks.save_training_table(first.drop("y"), "m", "8", database)


def test_append_merge_grows_the_schema_without_rewriting(spark, database):
    name = f"{database}.grows"
    sinks.append_merge(spark.createDataFrame([(1, "x")], "a int, b string"), name)
    before = set(spark.table(name).inputFiles())
    sinks.append_merge(spark.createDataFrame([("y", 2.5)], "b string, c double"), name)
    assert records(spark.table(name)) == [(1, "x", None), (None, "y", 2.5)]
    assert before < set(spark.table(name).inputFiles())


def test_publish_may_read_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sources.read_published(spark, path)
    sinks.publish(spark.range(3).toDF("n"), path)
    old = sources.read_published(spark, path)
    sinks.publish(old.withColumn("m", F.col("n") * 2), path)
    assert records(sources.read_published(spark, path)) == [(0, 0), (1, 2), (2, 4)]
    assert records(old) == [(0,), (1,), (2,)]


def test_unfinished_publication_is_not_read_and_not_reused(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.publish(spark.range(3), path)
    os.makedirs(f"{path}/v=2")
    assert sources.published_versions(spark, path) == [1]
    assert sinks.publish(spark.range(4), path).endswith("v=3")
    assert sources.read_published(spark, path).count() == 4


def test_ledger_starts_empty_and_keeps_old_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert sinks.ensure_ledger(spark, path, EXPORT_LEDGER) == (False, path)
    assert sinks.ensure_ledger(spark, path, EXPORT_LEDGER) == (True, path)
    empty = sources.read_published(spark, path)
    assert empty.count() == 0
    assert empty.schema == EXPORT_LEDGER
    row = sources.ledger_row(spark, [("workspace_w", "m", "1", "s3a://b/m/r")], EXPORT_LEDGER)
    sinks.append_to_ledger(spark, path, row)
    later = row.withColumn("timestamp", F.lit("2023-01-01").cast("timestamp"))
    ledger = sinks.append_to_ledger(spark, path, later)
    assert ledger.count() == 2
    assert sources.published_versions(spark, path) == [1]
    grown = sinks.append_to_ledger(spark, path, later.withColumn("note", F.lit("n")))
    assert sorted(r.note or "" for r in grown.collect()) == ["", "", "n"]
    assert sources.published_versions(spark, path) == [2]


def test_ledger_row_checks_its_values(spark):
    with pytest.raises(ValueError):
        sources.ledger_row(spark, [("a",), ("a", "b")], EXPORT_LEDGER)
    row = sources.ledger_row(spark, [("w", "m")], IMPORT_LEDGER)
    assert row.schema.fields == IMPORT_LEDGER.fields[:2]


def test_latest_row_breaks_ties_by_name_and_version(spark):
    rows = [("w", "b", "1", "l", None), ("w", "a", "2", "l", None), ("w", "a", "1", "l", None)]
    ledger = spark.createDataFrame(rows, EXPORT_LEDGER).withColumn(
        "timestamp", F.lit("2023-01-01").cast("timestamp")
    )
    ties = ("exported_model_name", "exported_model_version")
    assert latest_row(ledger, "timestamp", *ties).collect()[0][1:3] == ("a", "1")
    times = spark.range(9).select(F.timestamp_seconds("id").alias("timestamp"))
    plan = latest_row(times)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_latest_run(spark):
    runs = spark.createDataFrame(
        [("r1", "x", None), ("r2", "x", None), ("r3", "y", None)], RUNS
    ).withColumn("start_time", F.when(F.col("run_id") == "r1", F.lit("2023-01-02"))
                 .otherwise(F.lit("2023-01-01")).cast("timestamp"))
    assert [r.run_id for r in latest_run(runs, "x").collect()] == ["r1"]
    assert dict(latest_runs(runs).select("run_name", "run_id").collect()) == {"x": "r1", "y": "r3"}


def test_export_then_import(spark):
    versions = spark.createDataFrame(
        [
            ("m", "9", "Production", "", "r9"), ("m", "10", "Production", None, "r10"),
            ("done", "1", "Production", "Already Exported , old description: ", "d1"),
            ("new", "1", "None", "", "n1"),
        ],
        MODEL_VERSIONS,
    )
    exports = export_ledger_rows(versions, "w-1", "s3a://base", as_of="2023-05-01 00:00:00")
    assert exports.columns == EXPORT_LEDGER.fieldNames()
    assert [tuple(r)[:4] for r in exports.collect()] == [
        ("workspace_w-1", "m", "10", "s3a://base/mlflowexportmodels/workspace_w-1/m/r10")
    ]
    imports = import_ledger_rows(exports)
    assert imports.columns == IMPORT_LEDGER.fieldNames()
    assert [tuple(r)[:4] for r in imports.collect()] == [
        ("workspace_w-1", "imported_m", "10", "s3a://base/mlflowexportmodels/workspace_w-1/m/r10")
    ]


def documents(spark, *texts):
    return spark.createDataFrame([("m", t) for t in texts], "name string, document string")


def test_split_json_goes_by_column_name(spark):
    one = json.dumps({"columns": ["y", "x"], "data": [[1, 2.5], [None, 3]]})
    two = json.dumps({"columns": ["x", "z", "y"], "data": [[7, 8, 9]]})
    none = json.dumps({"columns": ["x", "y"], "data": []})
    rows = sources.explode_split_json(
        documents(spark, one, two, none, None), "document", ["x", "y"], position="place"
    )
    assert rows.columns == ["name", "place", "x", "y"]
    assert records(rows) == [("m", 0, 2.5, 1.0), ("m", 0, 7.0, 9.0), ("m", 1, 3.0, None)]


@pytest.mark.parametrize(
    "text",
    ['{"columns": ["x"], "data": [[1]]}', '{"columns": ["x", "y"], "data": [[1]]}',
     '{"columns": ["x", "y"], "data": [[1, 2, 3]]}', '{"columns": ["x"'],
)
def test_broken_documents_are_errors(spark, text):
    with pytest.raises(Exception, match="Malformed records|without a value for"):
        sources.explode_split_json(documents(spark, text), "document", ["x", "y"]).collect()


def test_json_is_parsed_once_per_document(spark, tmp_path):
    documents(spark, '{"columns": ["x"], "data": [[1]]}').write.parquet(str(tmp_path / "d"))
    rows = sources.explode_split_json(spark.read.parquet(str(tmp_path / "d")), "document", ["x"])
    assert rows._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


def test_split_json_round_trip_of_a_hot_group(spark):
    df = spark.range(0, 30_000, 1, 4).select(
        F.when(F.col("id") < 25_000, "hot").otherwise("m").alias("name"),
        (F.col("id") / 7).alias("x"),
        F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("y"),
    )
    texts = sinks.to_split_json(df, ["x", "y"])
    assert texts.count() > 2
    back = sources.explode_split_json(texts, "document", ["x", "y"])
    assert records(back) == records(df)


def test_run_values_need_a_key(spark):
    with pytest.raises(ValueError):
        sinks.run_values(spark.createDataFrame([("r", 1.0)], "run_id string, m double"))


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_split_json_spreads_copies(spark):
    row = F.when(F.col("id") % 3 == 0, -0.0).when(F.col("id") % 3 == 1, 2.0)
    df = spark.range(3000).select(F.lit("hot").alias("name"), row.alias("x"), F.lit(1.0).alias("y"))
    df = df.unionByName(spark.createDataFrame([(None, 0.0, 1.0)], "name string, x double, y double"))
    texts = sinks.to_split_json(df, ["x", "y"], rows_per_document=100).collect()
    assert max(len(json.loads(r.document)["data"]) for r in texts) <= 100
    back = sources.explode_split_json(
        sinks.to_split_json(df, ["x", "y"], rows_per_document=100), "document", ["x", "y"]
    )
    counted = {str(r.x): r["count"] for r in back.groupBy(F.col("x").cast("string").alias("x")).count().collect()}
    assert counted == {"-0.0": 1000, "2.0": 1000, "None": 1000, "0.0": 1}
    again = sinks.to_split_json(df.repartition(5), ["x", "y"], rows_per_document=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, texts))


def test_split_json_documents_are_full(spark):
    df = spark.range(0, 2500, 1, 4).select(
        F.when(F.col("id") < 2105, "hot").otherwise("m").alias("name"),
        F.when(F.col("id") < 700, 1.5).otherwise(F.col("id")).alias("x"),
    )
    texts = sinks.to_split_json(df, ["x"], rows_per_document=100).collect()
    sizes = {n: sorted(len(json.loads(r.document)["data"]) for r in texts if r.name == n) for n in ("hot", "m")}
    assert sizes == {"hot": [5] + [100] * 21, "m": [95, 100, 100, 100]}
    again = sinks.to_split_json(df.repartition(7), ["x"], rows_per_document=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, texts))
