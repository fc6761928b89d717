"""The whole life of a model version, one function per step.

The version table and the ledgers are published path tables. Steps write the rows they
change or add, nothing else. Exports and imports go to the version table and a ledger
together (``panelgate.plans.intents``): a step that was cut off is finished or undone by
the next one, and can be run again. A step that another one overtook starts anew.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgate.commits import Conflict, state
from panelgate.functions.numbers import version_number
from panelgate.functions.text import EXPORT_MARKER, last_segment
from panelgate.operators import features as ft
from panelgate.operators import models
from panelgate.operators import versions as mv
from panelgate.operators.features import stamp
from panelgate.operators.metrics import TOLERANCE, assert_valid, mse, score_two, validate_pair
from panelgate.operators.ordering import latest_row
from panelgate.plans.intents import VERSION_KEYS, commit_both, recover
from panelgate.plans.ledgers import as_imported, export_ledger_rows, newest_exports
from panelgate.plans.monitoring import monitor
from panelgate.plans.training import build_training_table
from panelgate.schemas import EXPORT_LEDGER, IMPORT_LEDGER, MODEL_VERSIONS
from panelgate.sinks import (
    append_changes,
    ensure_ledger,
    log_values,
    save_example,
    save_training_table,
)
from panelgate.sinks.ledgers import fitted
from panelgate.sources import read_path, read_published, read_table
from panelgate.storage import scratch_table

# What tells the rows of a ledger apart, and how often an overtaken step starts anew.
EXPORT_KEYS = ("from_workspace", "exported_model_name", "exported_model_version")
IMPORT_KEYS = ("from_workspace", "imported_model_name", "imported_model_version")
TRIES = 20


def example_path(root: str, name: str, version: str) -> str:
    return f"{root}/examples/{name}/{version}"


def train(
    long: DataFrame,
    versions_path: str,
    root: str,
    name: str,
    run_id: str,
    run_values: str,
    country: str = "USA",
    features: Sequence[str] = ft.FEATURES,
    y: str = ft.LABEL,
    database: str | None = None,
    **params,
) -> str:
    """Training table, fit, error, example and a new unstaged version; its number.

    The training table is written before the fit, which then reads the files and
    not the indicators again. If the version table changed meanwhile, the number may be
    taken: then the step fails and adds no version.
    """
    spark = long.sparkSession
    recover(spark, versions_path)
    now = state(spark, versions_path)
    versions = read_published(spark, versions_path, at=now)
    run = spark.createDataFrame([(name, run_id)], "name string, run_id string")
    added = spark.createDataFrame(mv.register(versions, run).collect(), MODEL_VERSIONS)
    version = added.head()["version"]
    table = read_table(
        spark,
        save_training_table(
            build_training_table(long, country, features, y), name, version, database
        ),
    )
    model = models.fit_regressor(table, features, **params)
    models.save_version(model, root, name, version)
    models.save_contract(table.select(*sorted(features)), root, name, version)
    save_example(table, example_path(root, name, version), features)
    error = mse(models.predict(table, model)).head()["mse"]
    rounds = params.get("maxIter", models.ROUNDS)
    log_values(spark, run_values, run_id, {"n_estimators": rounds}, {"accuracy": error})
    append_changes(added, versions_path, VERSION_KEYS, now.number)
    return version


def validate(
    spark: SparkSession,
    versions_path: str,
    root: str,
    table: DataFrame,
    submitted: tuple[str, str],
    retrained: str,
    tol: float = TOLERANCE,
) -> DataFrame:
    """Compare the submitted (name, version) with the newest unstaged ``retrained`` one.

    Both are scored on the given table. If they agree the retrained version goes
    to Staging, otherwise the step fails.
    """
    versions = read_published(spark, versions_path)
    user = models.load_version(versions, root, *submitted)
    own = models.load_version(versions, root, retrained, stage=mv.NONE)
    models.check_contract(table, models.load_contract(spark, root, *submitted))
    scored = models.predict(models.predict(table, user, "y_hat1"), own, "y_hat2")
    gate = validate_pair(score_two(scored), tol).withColumn("name", F.lit(retrained))
    result = spark.createDataFrame(gate.collect(), gate.schema)
    assert_valid(result)
    for _ in range(TRIES):
        now = state(spark, versions_path)
        rows = mv.promotions(read_published(spark, versions_path, at=now), result)
        try:
            append_changes(rows, versions_path, VERSION_KEYS, now.number)
            return result
        except Conflict:
            continue
    raise Conflict(f"{versions_path} changed during each of {TRIES} attempts")


def export(
    spark: SparkSession,
    versions_path: str,
    ledger_path: str,
    workspace: str,
    base: str,
    as_of=None,
    marker: str = EXPORT_MARKER,
) -> DataFrame:
    """Ledger after adding every model that is due; those are marked as exported.

    A registry without any Production version is an error. A version of a model that the
    ledger has from this workspace is marked, but not added once more.
    """
    ensure_ledger(spark, ledger_path, EXPORT_LEDGER)

    def plan(versions, ledger):
        mv.assert_any(versions, mv.PRODUCTION)
        due = mv.not_exported(mv.newest_in_stage(versions), marker)
        rows = export_ledger_rows(versions, workspace, base, as_of, marker)
        return mv.marked_exported(versions, due), _not_in(rows, ledger, EXPORT_KEYS)

    return _both(spark, versions_path, ledger_path, plan)


def import_newest(
    spark: SparkSession,
    export_ledger_path: str,
    versions_path: str,
    ledger_path: str,
    as_of=None,
) -> DataFrame:
    """Ledger after importing the newest export, unless the ledger already has it.

    The imported model gets its next version, in Production; the version that was
    newest there before is archived.
    """
    ensure_ledger(spark, ledger_path, IMPORT_LEDGER)
    newest = latest_row(read_published(spark, export_ledger_path), "timestamp", *EXPORT_KEYS[1:])
    return _both(spark, versions_path, ledger_path, _importing(newest, as_of))


def import_due(
    spark: SparkSession,
    export_ledger_path: str,
    versions_path: str,
    ledger_path: str,
    as_of=None,
) -> DataFrame:
    """Ledger after importing the newest export of every model that is not imported yet.

    Models of one name from several workspaces are imported in the order of their
    exports: each gets a number, the last one stays in Production.
    """
    ensure_ledger(spark, ledger_path, IMPORT_LEDGER)
    newest = newest_exports(read_published(spark, export_ledger_path))
    return _both(spark, versions_path, ledger_path, _importing(newest, as_of))


def _importing(exports, as_of):
    """What importing ``exports`` changes: versions lacking among the versions, rows in the ledger.

    Either table is asked for itself. Where an earlier import reached only one of them, the
    other one gets what it lacks.
    """

    def plan(versions, ledger):
        at = F.col("timestamp").alias("_exported")
        # Found once for both tables.
        imports = scratch_table(as_imported(exports, at), "newest")
        rows = _not_in(stamp(imports.drop("_exported"), as_of), ledger, IMPORT_KEYS)
        runs = imports.select(
            F.col("imported_model_name").alias("name"),
            last_segment("external_location").alias("run_id"),
            "_exported", "from_workspace",
            version_number("imported_model_version").alias("_number"),
        )
        new = scratch_table(runs.join(versions, ["name", "run_id"], "left_anti"), "imports")
        if new.isEmpty():
            return versions.limit(0), rows
        order = ["_exported", "from_workspace", "_number"]
        added = scratch_table(mv.register(versions, new, order), "added")
        # Each import archives the one before it, so only the last new version stays.
        last = added.groupBy("name").agg(F.max(F.col("version").cast("bigint")).alias("_last"))
        staged = F.when(F.col("version").cast("bigint") == F.col("_last"), mv.PRODUCTION)
        added = added.join(last, "name").withColumn("stage", staged.otherwise(mv.ARCHIVED))
        changes = mv.archived(versions, new).unionByName(added.drop("_last"))
        return changes, rows

    return plan


def _not_in(rows, ledger, keys):
    """Rows whose keys the ledger does not have; several rows of one key count once."""
    return rows.join(ledger.select(*keys), list(keys), "left_anti").select(*rows.columns)


def _both(spark, versions_path, ledger_path, plan):
    """Carry out what ``plan`` makes of the version table and the ledger; the new ledger.

    The rows are written down once, as the tables they are compared with may change.
    """
    recover(spark, versions_path)
    for _ in range(TRIES):
        now = state(spark, versions_path)
        ledger = read_published(spark, ledger_path)
        versions = read_published(spark, versions_path, at=now)
        changes, rows = plan(versions, ledger)
        changes = scratch_table(fitted(changes, versions), "changes")
        rows = scratch_table(fitted(rows, ledger), "rows")
        if changes.isEmpty() and rows.isEmpty():
            return ledger
        try:
            commit_both(versions_path, changes, now.number, ledger_path, rows)
            return read_published(spark, ledger_path)
        except Conflict:
            continue
    raise Conflict(f"{versions_path} changed during each of {TRIES} attempts")


def predict_example(
    spark: SparkSession, versions_path: str, root: str, name: str
) -> DataFrame:
    """Stored example of the newest Production version, with its predictions."""
    versions = read_published(spark, versions_path)
    version = mv.newest_version_of(versions, name, mv.PRODUCTION)
    example = read_path(spark, example_path(root, name, version))
    models.check_contract(example, models.load_contract(spark, root, name, version))
    return models.predict(example, models.load_version(versions, root, name, version))


def monitor_model(
    spark: SparkSession, versions_path: str, root: str, name: str, tol: float = TOLERANCE
) -> DataFrame:
    """Newest Production version against the one below, on the newest one's example."""
    versions = read_published(spark, versions_path).filter(F.col("name") == name)
    mv.assert_two_versions(versions, name)
    current = mv.newest_version_of(versions, name, mv.PRODUCTION)
    previous = str(int(current) - 1)
    loaded = {
        (name, v): models.load_version(versions, root, name, v) for v in (current, previous)
    }
    example = read_path(spark, example_path(root, name, current))
    models.check_contract(example, models.load_contract(spark, root, name, current))
    rows = example.withColumn("name", F.lit(name))
    score: Callable[[DataFrame], DataFrame] = models.score_pairs(loaded)
    return monitor(versions, rows, score, tol)
