"""Ledgers, path and catalog tables, and the naming expressions."""

from pyspark.sql import functions as F

from checks import shapes
from checks.registry import query
from panelgate import sinks, sources
from panelgate.functions import text
from panelgate.operators import ordering
from panelgate.plans import export_ledger_rows, import_ledger_rows, import_locations, steps
from panelgate.plans.ledgers import as_imported, due_imports
from panelgate.schemas import EXPORT_LEDGER

_AS_OF = "2023-05-01 12:00:00"


def _naive(df):
    """Timestamps without zone, as the other side has them."""
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("SELECT * FROM orders")
def src2_read_table(spark, sf_dir):
    name = f"{shapes.scratch_database(spark)}.orders_copy"
    shapes.table(spark, sf_dir, "orders").write.saveAsTable(name)
    return sources.read_table(spark, name)


@query("SELECT * FROM orders")
def src3_read_path(spark, sf_dir):
    return sources.read_path(spark, f"{sf_dir}/orders.parquet")


@query(f"""
    SELECT * FROM {shapes.LEDGER}
    UNION ALL
    SELECT 'workspace_x', 'm', '7', 's3a://x/m/m/r', TIMESTAMP '{_AS_OF}'""")
def src4_ledger_row(spark, sf_dir):
    row = sources.ledger_row(
        spark, [("workspace_x", "m", "7", "s3a://x/m/m/r")], EXPORT_LEDGER
    )
    stamped = row.withColumn("timestamp", F.lit(_AS_OF).cast("timestamp"))
    return _naive(shapes.ledger(spark, sf_dir).unionByName(stamped))


@query(f"SELECT * FROM {shapes.EXAMPLES}")
def src5_explode_split_json(spark, sf_dir):
    return sources.explode_split_json(
        shapes.documents(spark, sf_dir), "document", shapes.EXAMPLE_COLUMNS
    )


@query(f"SELECT * FROM {shapes.LEDGER}")
def snk2_snapshot_table(spark, sf_dir):
    name = f"{shapes.scratch_database(spark)}.working_copy"
    return _naive(sinks.snapshot_table(shapes.ledger(spark, sf_dir), name))


_MERGED = f"""
    SELECT *, NULL::VARCHAR AS note FROM {shapes.LEDGER}
    UNION ALL
    SELECT from_workspace, exported_model_name, exported_model_version, NULL, "timestamp",
           'again' FROM {shapes.LEDGER}"""


def _grown(ledger):
    return ledger.drop("external_location").withColumn("note", F.lit("again"))


@query(_MERGED)
def snk3_append_merge(spark, sf_dir):
    name = f"{shapes.scratch_database(spark)}.ledger"
    ledger = shapes.ledger(spark, sf_dir)
    sinks.append_merge(ledger, name)
    return _naive(sinks.append_merge(_grown(ledger), name))


@query(f"""
    SELECT * FROM {shapes.LEDGER} WHERE exported_model_name <> 'm1'""")
def snk4_publish(spark, sf_dir):
    path = shapes.scratch(spark)
    sinks.publish(shapes.ledger(spark, sf_dir), path)
    current = sources.read_published(spark, path)
    sinks.publish(current.filter("exported_model_name <> 'm1'"), path)
    return _naive(sources.read_published(spark, path))


@query("SELECT CAST(0 AS BIGINT) AS n_before, count(*) AS n_after FROM orders")
def snk5_ensure_ledger(spark, sf_dir):
    _, path = sinks.ensure_ledger(spark, shapes.scratch(spark), EXPORT_LEDGER)
    before = sources.read_published(spark, path).agg(F.count("*").alias("n_before"))
    counted = before.collect()[0][0]
    sinks.append_to_ledger(spark, path, shapes.ledger(spark, sf_dir))
    existed, _ = sinks.ensure_ledger(spark, path, EXPORT_LEDGER)
    assert existed
    after = sources.read_published(spark, path).agg(F.count("*").alias("n_after"))
    return after.select(F.lit(counted).cast("bigint").alias("n_before"), "n_after")


@query(_MERGED)
def snk6_append_to_ledger(spark, sf_dir):
    ledger = shapes.ledger(spark, sf_dir)
    _, path = sinks.ensure_ledger(spark, shapes.scratch(spark), EXPORT_LEDGER)
    sinks.append_to_ledger(spark, path, ledger)
    return _naive(sinks.append_to_ledger(spark, path, _grown(ledger)))


@query("""
    SELECT 'r' || CAST(o_orderkey AS VARCHAR) AS run_id, 'param' AS kind,
           'n_estimators' AS key, CAST(o_orderkey % 10 AS DOUBLE) AS value FROM orders
    UNION ALL
    SELECT 'r' || CAST(o_orderkey AS VARCHAR), 'metric', 'accuracy', o_totalprice FROM orders
    UNION ALL
    SELECT 'last', 'param', 'n_estimators', 1000.0""")
def snk7_log_values(spark, sf_dir):
    name = f"{shapes.scratch_database(spark)}.run_values"
    runs = shapes.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"),
        (F.col("o_orderkey") % 10).alias("n_estimators"),
        F.col("o_totalprice").alias("accuracy"),
    )
    sinks.log_run_values(runs, name, params=["n_estimators"], metrics=["accuracy"])
    return sinks.log_values(spark, name, "last", params={"n_estimators": 1000})


@query(f"""
    SELECT "Daily_ICU_occupancy", "Daily_hospital_occupancy", quarter, y
    FROM {shapes.EXAMPLES}""")
def snk8_save_example(spark, sf_dir):
    examples = sources.explode_split_json(
        shapes.documents(spark, sf_dir), "document", shapes.EXAMPLE_COLUMNS
    )
    return sinks.save_example(examples, shapes.scratch(spark))


@query(f"SELECT * FROM {shapes.EXAMPLES}")
def snk8_to_split_json(spark, sf_dir):
    examples = sources.explode_split_json(
        shapes.documents(spark, sf_dir), "document", shapes.EXAMPLE_COLUMNS
    )
    documents = sinks.to_split_json(examples, shapes.EXAMPLE_COLUMNS)
    return sources.explode_split_json(documents, "document", shapes.EXAMPLE_COLUMNS)


_TIES = ("exported_model_name", "exported_model_version")
_NEWEST_FIRST = '"timestamp" DESC, exported_model_name, exported_model_version'


@query(f"""
    SELECT *, row_number() OVER (ORDER BY {_NEWEST_FIRST}) - 1 AS position
    FROM {shapes.LEDGER}""")
def so2_newest_first(spark, sf_dir):
    ledger = ordering.newest_first(shapes.ledger(spark, sf_dir), "timestamp", *_TIES)
    return _naive(ordering.with_position(ledger))


@query(f"SELECT * FROM {shapes.LEDGER} ORDER BY {_NEWEST_FIRST} LIMIT 1")
def so3_latest_row(spark, sf_dir):
    return _naive(ordering.latest_row(shapes.ledger(spark, sf_dir), "timestamp", *_TIES))


def _runs(spark, sf_dir):
    return shapes.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.concat(F.lit("run_of_"), F.col("o_custkey").cast("string")).alias("run_name"),
        F.col("o_orderdate").alias("start_time"),
    )


@query("""
    SELECT run_name, run_id, start_time FROM (
      SELECT 'run_of_' || CAST(o_custkey AS VARCHAR) AS run_name,
             'r' || CAST(o_orderkey AS VARCHAR) AS run_id, o_orderdate AS start_time,
             row_number() OVER (PARTITION BY o_custkey
               ORDER BY o_orderdate DESC, 'r' || CAST(o_orderkey AS VARCHAR)) AS rn
      FROM orders) WHERE rn = 1""")
def so4_latest_runs(spark, sf_dir):
    return ordering.latest_runs(_runs(spark, sf_dir))


@query("""
    SELECT 'r' || CAST(o_orderkey AS VARCHAR) AS run_id,
           'run_of_' || CAST(o_custkey AS VARCHAR) AS run_name, o_orderdate AS start_time
    FROM orders WHERE o_custkey = 100
    ORDER BY start_time DESC, run_id LIMIT 1""")
def so4_latest_run(spark, sf_dir):
    return ordering.latest_run(_runs(spark, sf_dir), "run_of_100")


def _scalar(spark, sf_dir, value):
    return shapes.ledger(spark, sf_dir).select("exported_model_version", value.alias("result"))


def _scalar_sql(value):
    return f"SELECT exported_model_version, {value} AS result FROM {shapes.LEDGER}"


@query(_scalar_sql("split_part(from_workspace, '_', 2)"))
def sc1_workspace_id(spark, sf_dir):
    return _scalar(spark, sf_dir, text.workspace_id("from_workspace"))


@query(_scalar_sql("regexp_replace(external_location, '/[^/]*$', '')"))
def sc2_parent_path(spark, sf_dir):
    return _scalar(spark, sf_dir, text.parent_path("external_location"))


@query(_scalar_sql("split_part(external_location, '/', -1)"))
def sc3_last_segment(spark, sf_dir):
    return _scalar(spark, sf_dir, text.last_segment("external_location"))


@query(_scalar_sql("'imported_' || exported_model_name"))
def sc4_prefixed(spark, sf_dir):
    return _scalar(spark, sf_dir, text.prefixed("exported_model_name", "imported_"))


@query(_scalar_sql(
    "'s3a://base/mlflowexportmodels/' || from_workspace || '/' || exported_model_name"))
def sc4_location(spark, sf_dir):
    place = text.location(
        F.lit("s3a://base"), F.lit("mlflowexportmodels"), "from_workspace", "exported_model_name"
    )
    return _scalar(spark, sf_dir, place)


@query(_scalar_sql("replace(external_location, 's3a:', '/s3a')"))
def sc5_replace_text(spark, sf_dir):
    return _scalar(spark, sf_dir, text.replace_text("external_location", "s3a:", "/s3a"))


@query(f"""
    SELECT name, version,
           'Already Exported , old description: ' || coalesce(description, '') AS result
    FROM {shapes.VERSIONS}""")
def sc7_exported_description(spark, sf_dir):
    return shapes.versions(spark, sf_dir).select(
        "name", "version", text.exported_description("description").alias("result")
    )


@query(f"""
    SELECT 'workspace_w' AS from_workspace, name AS exported_model_name,
           version AS exported_model_version,
           's3a://base/mlflowexportmodels/workspace_w/' || name || '/' || run_id
             AS external_location,
           TIMESTAMP '{_AS_OF}' AS "timestamp"
    FROM (SELECT *, row_number() OVER (PARTITION BY name
            ORDER BY CAST(version AS BIGINT) DESC) AS rn
          FROM {shapes.VERSIONS} WHERE stage = 'Production')
    WHERE rn = 1 AND NOT contains(coalesce(description, ''), 'Already Exported ')""")
def pl2_export_ledger_rows(spark, sf_dir):
    rows = export_ledger_rows(shapes.versions(spark, sf_dir), "w", "s3a://base", as_of=_AS_OF)
    return _naive(rows)


_IMPORTED = """
    'workspace_' || split_part(from_workspace, '_', 2) AS from_workspace,
    'imported_' || exported_model_name AS imported_model_name,
    exported_model_version AS imported_model_version, external_location"""


@query(f"""
    SELECT {_IMPORTED}, TIMESTAMP '{_AS_OF}' AS "timestamp"
    FROM (SELECT * FROM {shapes.LEDGER} ORDER BY {_NEWEST_FIRST} LIMIT 1)""")
def pl3_import_ledger_rows(spark, sf_dir):
    return _naive(import_ledger_rows(shapes.ledger(spark, sf_dir), as_of=_AS_OF))


_DONE = "CAST(exported_model_version AS BIGINT) % 4 = 1"


@query(f"""
    SELECT from_workspace, exported_model_name, exported_model_version, external_location,
           "timestamp"
    FROM (SELECT *, row_number() OVER (PARTITION BY from_workspace, exported_model_name
            ORDER BY "timestamp" DESC, CAST(exported_model_version AS BIGINT) DESC) AS rn
          FROM {shapes.LEDGER})
    WHERE rn = 1 AND NOT ({_DONE})""")
def pl3_due_imports(spark, sf_dir):
    """Newest exports, of which every fourth version is imported already."""
    ledger = shapes.ledger(spark, sf_dir)
    done = as_imported(ledger.filter(F.col("exported_model_version").cast("bigint") % 4 == 1))
    return _naive(due_imports(ledger, done))


@query(f"SELECT {_IMPORTED} FROM {shapes.LEDGER}")
def pl3_as_imported(spark, sf_dir):
    return as_imported(shapes.ledger(spark, sf_dir))


@query(f"""
    SELECT 'imported_' || exported_model_name AS name,
           regexp_replace(external_location, '/[^/]*$', '') AS input_dir,
           split_part(external_location, '/', -1) AS run_id,
           's3a://scratch/workspace_' || split_part(from_workspace, '_', 2) || '/'
             || exported_model_name AS scratch_dir,
           '/Shared/mlflow_experiments/exp_imported_' || exported_model_name AS experiment_name
    FROM {shapes.LEDGER}""")
def pl3_import_locations(spark, sf_dir):
    return import_locations(shapes.ledger(spark, sf_dir), "s3a://scratch")


def _due():
    """Newest exports under their new names, with the number each gets within its model."""
    return f"""
    (SELECT *, row_number() OVER (PARTITION BY imported_model_name ORDER BY "timestamp",
              from_workspace, CAST(imported_model_version AS BIGINT)) AS number,
            row_number() OVER (PARTITION BY imported_model_name ORDER BY "timestamp" DESC,
              from_workspace DESC, CAST(imported_model_version AS BIGINT) DESC) AS from_last
     FROM (SELECT {_IMPORTED}, "timestamp",
             row_number() OVER (PARTITION BY from_workspace, exported_model_name
               ORDER BY "timestamp" DESC, CAST(exported_model_version AS BIGINT) DESC) AS rn
           FROM {shapes.LEDGER}) WHERE rn = 1)"""


def _import_all(spark, sf_dir):
    """Whole export ledger through the import step, twice: the second run adds nothing."""
    base = shapes.scratch(spark)
    exports, versions, imports = (f"{base}/{n}" for n in ("exports", "versions", "imports"))
    sinks.publish(shapes.ledger(spark, sf_dir), exports)
    sinks.publish(shapes.versions(spark, sf_dir), versions)
    for _ in (1, 2):
        ledger = steps.import_due(spark, exports, versions, imports, _AS_OF)
    return ledger, sources.read_published(spark, versions)


@query(f"""
    SELECT from_workspace, imported_model_name, imported_model_version, external_location,
           TIMESTAMP '{_AS_OF}' AS "timestamp" FROM {_due()}""")
def pl3_import_due(spark, sf_dir):
    """Import ledger after the step; models of one name come from many workspaces."""
    return _naive(_import_all(spark, sf_dir)[0])


@query(f"""
    SELECT imported_model_name AS name, CAST(number AS VARCHAR) AS version,
           CASE WHEN from_last = 1 THEN 'Production' ELSE 'Archived' END AS stage,
           '' AS description, split_part(external_location, '/', -1) AS run_id
    FROM {_due()}
    UNION ALL SELECT * FROM {shapes.VERSIONS}""")
def pl3_import_due_versions(spark, sf_dir):
    """Version table after the step: all that was there and the numbered imports."""
    return _import_all(spark, sf_dir)[1]


@query(f"""
    SELECT 'workspace_w' AS from_workspace, name AS exported_model_name,
           version AS exported_model_version,
           's3a://base/mlflowexportmodels/workspace_w/' || name || '/' || run_id
             AS external_location,
           TIMESTAMP '{_AS_OF}' AS "timestamp"
    FROM (SELECT *, row_number() OVER (PARTITION BY name
            ORDER BY CAST(version AS BIGINT) DESC) AS rn
          FROM {shapes.VERSIONS} WHERE stage = 'Production')
    WHERE rn = 1 AND NOT contains(coalesce(description, ''), 'Already Exported ')""")
def pl2_export_twice(spark, sf_dir):
    """Export ledger after the step ran twice: every version once."""
    base = shapes.scratch(spark)
    sinks.publish(shapes.versions(spark, sf_dir), f"{base}/versions")
    for _ in (1, 2):
        ledger = steps.export(spark, f"{base}/versions", f"{base}/ledger", "w", "s3a://base", _AS_OF)
    return _naive(ledger)
