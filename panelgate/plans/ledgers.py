"""Ledger rows of exports and imports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgate.columns import named
from panelgate.functions.numbers import version_number
from panelgate.functions.text import (
    EXPORT_MARKER,
    last_segment,
    location,
    parent_path,
    prefixed,
    workspace_id,
)
from panelgate.operators.features import stamp
from panelgate.operators.ordering import latest_row
from panelgate.operators.versions import newest_in_stage, not_exported

# Parts of ledger names and locations.
WORKSPACE_PREFIX = "workspace_"
IMPORT_PREFIX = "imported_"
EXPORT_FOLDER = "mlflowexportmodels"
EXPERIMENT_PREFIX = "/Shared/mlflow_experiments/exp_"


def export_ledger_rows(
    versions: DataFrame, workspace: str, base: str, as_of=None, marker: str = EXPORT_MARKER
) -> DataFrame:
    """One row per model whose newest Production version is still to be exported.

    The run comes along with the newest version, so the version table is read and
    shuffled once. Models without a Production version have nothing to export.
    """
    due = not_exported(newest_in_stage(versions), marker)
    from_workspace = F.lit(WORKSPACE_PREFIX + workspace)
    rows = due.select(
        from_workspace.alias("from_workspace"),
        F.col("name").alias("exported_model_name"),
        F.col("version").alias("exported_model_version"),
        location(
            F.lit(base), F.lit(EXPORT_FOLDER), from_workspace, "name", "run_id"
        ).alias("external_location"),
    )
    return stamp(rows, as_of)


def import_ledger_rows(export_ledger: DataFrame, as_of=None) -> DataFrame:
    """The row that importing the newest export writes to the import ledger."""
    newest = latest_row(
        export_ledger, "timestamp", "exported_model_name", "exported_model_version"
    )
    return stamp(as_imported(newest), as_of)


def due_imports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Newest export of every (workspace, model) that the import ledger does not have.

    One plan for all of them; versions of one moment go by their numbers. An export
    that a newer one of its model has overtaken is not imported any more.
    """
    rows = newest_exports(exports).select(
        *exports.columns,
        prefixed(workspace_id("from_workspace"), WORKSPACE_PREFIX).alias("_workspace"),
        prefixed("exported_model_name", IMPORT_PREFIX).alias("_name"),
    )
    done = imports.select(
        F.col("from_workspace").alias("_workspace"),
        F.col("imported_model_name").alias("_name"),
        F.col("imported_model_version").alias("exported_model_version"),
    )
    due = rows.join(done, ["_workspace", "_name", "exported_model_version"], "left_anti")
    return due.select(*exports.columns)


def newest_exports(exports: DataFrame) -> DataFrame:
    """Newest export of every (workspace, model), found in one shuffle of a row per task.

    Versions of one moment go by their numbers, equal ones by all other columns, so a
    rerun takes the same row.
    """
    last = Window.partitionBy("from_workspace", "exported_model_name").orderBy(
        F.col("timestamp").desc_nulls_last(),
        version_number("exported_model_version").desc_nulls_last(),
        *[named(c) for c in exports.columns],
    )
    nth = F.row_number().over(last)
    return exports.withColumn("_nth", nth).filter(F.col("_nth") == 1).drop("_nth")


def as_imported(exports: DataFrame, *more: Column) -> DataFrame:
    """Export rows under the names they get in the importing workspace, with ``more`` columns."""
    return exports.select(
        prefixed(workspace_id("from_workspace"), WORKSPACE_PREFIX).alias("from_workspace"),
        prefixed("exported_model_name", IMPORT_PREFIX).alias("imported_model_name"),
        F.col("exported_model_version").alias("imported_model_version"),
        "external_location",
        *more,
    )


def import_locations(exports: DataFrame, scratch: str) -> DataFrame:
    """What the copy step of an import needs to know about each export row."""
    workspace = prefixed(workspace_id("from_workspace"), WORKSPACE_PREFIX)
    imported = prefixed("exported_model_name", IMPORT_PREFIX)
    return exports.select(
        imported.alias("name"),
        parent_path("external_location").alias("input_dir"),
        last_segment("external_location").alias("run_id"),
        location(F.lit(scratch), workspace, "exported_model_name").alias("scratch_dir"),
        prefixed(imported, EXPERIMENT_PREFIX).alias("experiment_name"),
    )
