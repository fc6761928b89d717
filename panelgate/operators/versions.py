"""Model-version tables: newest, previous and not yet exported versions, and stages.

The table holds one row per ``(name, version)`` with ``stage``, ``description``
and ``run_id``; versions are whole numbers kept as text. Every operator handles all models at once. Models are reduced to
one row each before anything is joined on the name, so a model that owns a third
of all versions does not slow a join down.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgate.columns import required
from panelgate.functions.numbers import version_number
from panelgate.functions.text import EXPORT_MARKER, exported_description
from panelgate.operators.metrics import GateFailed
from panelgate.operators.ordering import running_sum

# Stage names, and what is reported or written by the transitions.
NONE, STAGING, PRODUCTION, ARCHIVED = "None", "Staging", "Production", "Archived"
NO_PRODUCTION_VERSION = "-1000"
NO_PRODUCTION_DESCRIPTION = (
    "error, this model does not have any production stages and should not be exported"
)
PROMOTED_DESCRIPTION = "Tests passed, ready to transition to 'Production'"


def _number():
    return version_number("version")


def in_stage(versions: DataFrame, stage: str) -> DataFrame:
    return versions.filter(F.col("stage") == stage)


def already_exported(versions: DataFrame, marker: str = EXPORT_MARKER) -> DataFrame:
    """Versions whose description contains the marker; no description means no."""
    return versions.filter(_is_marked(F.col("description"), marker))


def not_exported(versions: DataFrame, marker: str = EXPORT_MARKER) -> DataFrame:
    return versions.filter(~_is_marked(F.col("description"), marker))


def _is_marked(description, marker):
    return F.coalesce(description, F.lit("")).contains(marker)


def versions_in_stage(versions: DataFrame, stage: str = PRODUCTION) -> DataFrame:
    """Numeric versions of every model in one stage, one row each."""
    return in_stage(versions, stage).select("name", _number().alias("version"))


def _newest(rows, *by, number=None):
    """One row per group, that with the largest number (the version's, unless given).

    Each task keeps one row of a group before the only shuffle, so a model that owns a
    third of all versions sends as many rows as there are tasks. Rows without a number
    come last; equal numbers go by the text of the version, the longer one first.
    """
    numbered = rows.withColumn("_number", _number() if number is None else number)
    first = Window.partitionBy(*by).orderBy(
        F.col("_number").desc_nulls_last(), F.length("version").desc(), "version", "run_id"
    )
    return numbered.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") == 1)


def _latest_number(versions, stage):
    newest = in_stage(versions, stage).groupBy("name").agg(F.max(_number()).alias("v"))
    return newest.filter(F.col("v") > 0)


def latest_version(versions: DataFrame, stage: str = NONE) -> DataFrame:
    """Largest version of every model in a stage, as text. Version 0 counts as none."""
    return _latest_number(versions, stage).select(
        "name", F.col("v").cast("string").alias("version")
    )


def newest_version_of(versions: DataFrame, name: str, stage: str = NONE) -> str:
    """Largest version of one model in a stage; an error if there is none."""
    row = latest_version(versions.filter(F.col("name") == name), stage).head()
    if row is None:
        raise LookupError(f"model {name} has no version in stage {stage}")
    return row["version"]


def latest_per_stage(versions: DataFrame) -> DataFrame:
    """Newest version of every (model, stage) with its description and run."""
    fields = ("name", "stage", "version", "description", "run_id")
    return _newest(versions, "name", "stage").select(*fields)


def newest_in_stage(versions: DataFrame, stage: str = PRODUCTION) -> DataFrame:
    """Newest version of every model in one stage, the filter reaching the scan."""
    return latest_per_stage(in_stage(versions, stage))


def export_candidates(versions: DataFrame, marker: str = EXPORT_MARKER) -> DataFrame:
    """Per model: newest Production version, its description, and whether to export it.

    A model without one is reported with version ``-1000`` and is not exported.
    """
    number = F.when(F.col("stage") == PRODUCTION, _number())
    newest = _newest(versions, "name", number=number)
    v, missing = F.col("_number"), F.col("_number").isNull()
    return newest.select(
        "name",
        (~missing & ~_is_marked(F.col("description"), marker)).alias("should_export"),
        F.coalesce(v.cast("string"), F.lit(NO_PRODUCTION_VERSION)).alias("version"),
        F.when(missing, NO_PRODUCTION_DESCRIPTION).otherwise(F.col("description"))
        .alias("description"),
    )


def models_having_stage(versions: DataFrame, stage: str = PRODUCTION) -> DataFrame:
    return in_stage(versions, stage).select("name").distinct()


def run_ids(candidates: DataFrame, versions: DataFrame) -> DataFrame:
    """Add the run of each (name, version), looked up among the newest of each stage.

    A version that is not the newest of any stage keeps a null ``run_id``.
    """
    newest = latest_per_stage(versions).select("name", "version", "run_id")
    return candidates.join(newest, ["name", "version"], "left")


def to_archive(incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """Newest Production version of every model that is about to be imported."""
    names = incoming.select("name").distinct()
    newest = newest_in_stage(versions).select("name", "version")
    return newest.join(names, "name", "left_semi")


def previous_version(versions: DataFrame) -> DataFrame:
    """Newest Production version (from 2 up) beside the version numbered one below.

    The one below may be in any stage. Where that number does not exist,
    ``previous_found`` is false.
    """
    return version_pairs(versions).filter("ok").select(
        "name", "version", "previous_version", "previous_found"
    )


def version_pairs(versions: DataFrame) -> DataFrame:
    """Per model: newest Production version (``-1000`` for none) and the one numbered below.

    ``ok`` says whether the newest is 2 or above; without that there is no previous
    version. One number per model is combined by hashing; it and the one below are then
    looked up together under the unique (name, number), so no hot model meets in a task.
    """
    newest = versions.groupBy("name").agg(
        F.max(F.when(F.col("stage") == PRODUCTION, _number())).alias("v")
    )
    both = newest.select(
        "name", "v", F.explode(F.array(F.col("v"), F.col("v") - 1)).alias("number")
    )
    known = versions.select("name", _number().alias("number"), F.col("version").alias("text"))
    found = both.join(known, ["name", "number"], "left").groupBy("name", "v").agg(
        F.max(F.when(F.col("number") == F.col("v"), F.col("text"))).alias("text"),
        F.max(F.when(F.col("number") < F.col("v"), F.col("text"))).alias("below"),
    )
    ok = F.coalesce(F.col("v") >= 2, F.lit(False))
    number = F.coalesce(F.col("v").cast("string"), F.lit(NO_PRODUCTION_VERSION))
    below = F.coalesce("below", (F.col("v") - 1).cast("string"))
    return found.select(
        "name",
        F.when(ok, F.col("text")).otherwise(number).alias("version"),
        F.when(ok, below).alias("previous_version"),
        (ok & F.col("below").isNotNull()).alias("previous_found"),
        ok.alias("ok"),
    )


def require_stage(versions: DataFrame, stage: str = PRODUCTION) -> DataFrame:
    """Per model: number of versions in the stage, and whether there is one."""
    counted = versions.groupBy("name").agg(
        F.count_if(F.col("stage") == stage).alias("n_versions")
    )
    return counted.withColumn("ok", F.col("n_versions") > 0)


def assert_stage(versions: DataFrame, name: str, stage: str = PRODUCTION) -> None:
    if in_stage(versions.filter(F.col("name") == name), stage).isEmpty():
        raise GateFailed(f"model {name} has no version in stage {stage}")


def assert_any(versions: DataFrame, stage: str = PRODUCTION) -> None:
    """Fail unless some model has a version in the stage."""
    if in_stage(versions, stage).isEmpty():
        raise GateFailed(f"no model has a version in stage {stage}")


def require_two_versions(versions: DataFrame) -> DataFrame:
    """Per model: newest Production version, ``-1000`` for none, and whether it is 2 or above."""
    number = F.when(F.col("stage") == PRODUCTION, _number())
    newest = versions.groupBy("name").agg(F.max(number).alias("v"))
    v = F.coalesce(F.col("v"), F.lit(int(NO_PRODUCTION_VERSION)).cast("bigint"))
    return newest.select("name", v.cast("string").alias("version"), (v >= 2).alias("ok"))


def assert_two_versions(versions: DataFrame, name: str) -> None:
    one_model = require_two_versions(versions.filter(F.col("name") == name))
    if one_model.filter("ok").isEmpty():
        raise GateFailed(f"model {name} has fewer than 2 production versions to compare")


def _changed(versions, targets, **changes):
    """The rows of (name, version) that ``targets`` lists, with some columns changed.

    Versions are compared as numbers, so ``007`` and ``7`` are the same one.
    """
    marked = targets.select("name", _number().alias("_number"))
    numbered = versions.withColumn("_number", _number())
    return numbered.join(marked, ["name", "_number"], "left_semi").select(
        *[changes[c].alias(c) if c in changes else F.col(c) for c in versions.columns]
    )


def _rewrite(versions, targets, **changes):
    """All versions, with some columns changed on the rows ``targets`` lists once each."""
    marked = targets.select("name", _number().alias("_number"), F.lit(True).alias("_hit"))
    joined = versions.withColumn("_number", _number()).join(marked, ["name", "_number"], "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).alias(c)
            if c in changes
            else F.col(c)
            for c in versions.columns
        ]
    )


def _to_promote(versions, gate):
    passed = gate.filter(F.col("outcome") == "passed").select("name")
    return latest_version(versions, NONE).join(passed, "name", "left_semi")


def _promotion():
    return {"stage": F.lit(STAGING), "description": F.lit(PROMOTED_DESCRIPTION)}


def promote(versions: DataFrame, gate: DataFrame) -> DataFrame:
    """Newest unstaged version of every model that passed its gate goes to Staging."""
    return _rewrite(versions, _to_promote(versions, gate), **_promotion())


def promotions(versions: DataFrame, gate: DataFrame) -> DataFrame:
    """Only the rows that ``promote`` changes, as they are afterwards."""
    return _changed(versions, _to_promote(versions, gate), **_promotion())


def archive_previous(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest Production version of every incoming model goes to Archived."""
    return _rewrite(versions, to_archive(incoming, versions), stage=F.lit(ARCHIVED))


def archived(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Only the rows that ``archive_previous`` changes, as they are afterwards."""
    return _changed(versions, to_archive(incoming, versions), stage=F.lit(ARCHIVED))


def mark_exported(versions: DataFrame, exported: DataFrame) -> DataFrame:
    """Descriptions of the exported (name, version) rows get the export marker."""
    once = exported.select("name", "version").distinct()
    return _rewrite(versions, once, description=exported_description("description"))


def marked_exported(versions: DataFrame, exported: DataFrame) -> DataFrame:
    """Only the rows that ``mark_exported`` changes, as they are afterwards."""
    return _changed(versions, exported, description=exported_description("description"))


def register(
    versions: DataFrame, runs: DataFrame, order: Sequence[str | Column] = ()
) -> DataFrame:
    """Rows of the new versions: the runs of a model get its next numbers.

    ``runs`` holds ``(name, run_id)`` and what ``order`` names, by which several runs of
    a model are numbered, smallest first, equal ones by ``run_id``. Without an order two
    runs of one model in the same call are an error. A model with a third of all runs is
    numbered in ranges. Runs without a name are an error too.
    """
    known = versions.groupBy("name").agg(F.max(_number()).alias("_last"))
    if order:
        runs = running_sum(runs, ["name"], [*order, "run_id"], name="_nth")
    else:
        runs = runs.groupBy("name").agg(F.max("run_id").alias("run_id"), F.count("*").alias("_n"))
        twice = F.concat(F.lit("more than one new run of model "), F.col("name"))
        runs = runs.withColumn(
            "_nth", F.when(F.col("_n") == 1, F.lit(0)).otherwise(F.raise_error(twice))
        )
    following = F.coalesce("_last", F.lit(0)) + 1 + F.col("_nth")
    return runs.join(known, "name", "left").select(
        required(F.col("name"), "a run without a model").alias("name"),
        following.cast("string").alias("version"),
        F.lit(NONE).alias("stage"),
        F.lit("").alias("description"),
        "run_id",
    )
