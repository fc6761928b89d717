"""Catalog tables and published path tables."""

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgate.columns import named, require_columns
from panelgate.commits import Conflict, claim_folder, commit, state
from panelgate.sources.tables import read_published
from panelgate.storage import age_seconds, children, delete


def training_table_name(model: str, version: str, database: str | None = None) -> str:
    name = f"final_train_{model}_{version}"
    return f"{database}.{name}" if database else name


def save_training_table(
    df: DataFrame, model: str, version: str, database: str | None = None, fmt: str = "parquet"
) -> str:
    """Write the training table of one model version, replacing data and schema."""
    require_columns(df, "y")
    name = training_table_name(model, version, database)
    writer = df.write.format(fmt).mode("overwrite")
    if fmt == "delta":
        writer = writer.option("overwriteSchema", True)
    writer.saveAsTable(name)
    return name


def snapshot_table(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Copy into a working table, replacing it."""
    df.write.format(fmt).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def append_merge(df: DataFrame, table: str, fmt: str = "parquet") -> DataFrame:
    """Append by column name; new columns are added, missing ones become null.

    Only the new rows are written: the table's schema grows in the catalog, and
    files written before simply lack the column.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        df.write.format(fmt).saveAsTable(table)
        return spark.table(table)
    known = {f.name: f.dataType for f in spark.table(table).schema.fields}
    added = [f for f in df.schema.fields if f.name not in known]
    if added:
        columns = ", ".join(
            "`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString())
            for f in added
        )
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
    rows = [
        named(f.name)
        if f.name in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in spark.table(table).schema.fields
    ]
    df.select(*rows).write.format(fmt).mode("append").saveAsTable(table)
    return spark.table(table)


def publish(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    based_on: int | None = None,
    step: str | None = None,
) -> str:
    """Replace a path table that may be read meanwhile, also by ``df`` itself.

    Every call writes a new ``v=<n>`` folder of its own and then commits it, so a lost
    job leaves the former version in place. With ``based_on`` the table must still be at
    that commit; otherwise the folder is removed and ``Conflict`` raised.
    """
    if fmt == "delta":
        df.write.format(fmt).mode("overwrite").option("mergeSchema", True).save(path)
        return path
    spark = df.sparkSession
    folder = claim_folder(spark, path)
    df.write.format(fmt).mode("errorifexists").save(f"{path}/{folder}")
    return _committed(spark, path, "whole", folder, (), step, based_on)


def _committed(spark, path, kind, folder, keys, step, based_on):
    try:
        commit(spark, path, kind, folder, keys, step, based_on)
    except Conflict:
        delete(spark, f"{path}/{folder}")
        raise
    return f"{path}/{folder}"


def update_published(
    spark: SparkSession,
    path: str,
    change: Callable[[DataFrame], DataFrame],
    fmt: str = "parquet",
    tries: int = 20,
) -> str:
    """Replace a path table by ``change`` of itself, and again on the newer one if it moved."""
    for _ in range(tries):
        now = state(spark, path)
        try:
            return publish(
                change(read_published(spark, path, fmt, now)), path, fmt, now.number
            )
        except Conflict:
            continue
    raise Conflict(f"{path} changed during each of {tries} attempts")


def stage_rows(df: DataFrame, path: str, kind: str = "rows", fmt: str = "parquet") -> str:
    """Write rows or changes beside a path table, for ``commit`` to add them; their folder."""
    folder = f"{kind}-{uuid.uuid4().hex}"
    df.write.format(fmt).mode("errorifexists").save(f"{path}/{folder}")
    return folder


def append_changes(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    based_on: int | None = None,
    step: str | None = None,
    fmt: str = "parquet",
) -> str:
    """Replace rows of a path table by key, and add those with new keys, writing only these.

    ``df`` holds whole rows in the table's columns and each key once. A table has the same
    keys in all its changes. ``based_on`` is as for ``publish``.
    """
    folder = stage_rows(df, path, "changes", fmt)
    return _committed(df.sparkSession, path, "changes", folder, tuple(keys), step, based_on)


def compact(spark: SparkSession, path: str, fmt: str = "parquet") -> str:
    """Write a table's rows and changes together as one new version."""
    return update_published(spark, path, lambda table: table, fmt)


def remove_old(spark: SparkSession, path: str, older_than: float = 7 * 24 * 3600) -> list[str]:
    """Delete data folders that the table no longer consists of, unless changed lately.

    Readers of an earlier state and writers at work need theirs, so ``older_than`` seconds
    must be longer than any of them takes.
    """
    now = state(spark, path)
    used = {now.whole, *[c.folder for c in now.rows + now.changes]} if now else set()
    gone = []
    for name in children(spark, path):
        if name.startswith("_") or name in used:
            continue
        if age_seconds(spark, f"{path}/{name}") >= older_than:
            delete(spark, f"{path}/{name}")
            gone.append(name)
    return gone
