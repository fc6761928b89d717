"""Readers for indicator files, catalog tables, path tables and literal rows."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgate.columns import named
from panelgate.commits import State, state

# Texts that mean "no value" in an indicator file.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]


def read_indicators(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Indicator CSV with a header; every column as text, NA tokens as null.

    Columns go by name: without ``columns`` the header of the first file is looked
    up, and files with another header are an error. Dates stay text, numbers are
    made by ``to_numeric``. Files are split, so a record must fit on one line;
    ``multi_line`` allows line breaks inside quotes and reads each file in one task.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    reader = reader.option("multiLine", multi_line)
    if columns is None:
        columns = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = reader.option("enforceSchema", False).schema(schema).csv(path)
    return raw.select(
        *[F.when(~named(c).isin(NA_TOKENS), named(c)).alias(c) for c in columns]
    )


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_path(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def published_versions(spark: SparkSession, path: str) -> list[int]:
    """Number of the ``v=<n>`` folder that the table rests on, as a list of at most one."""
    now = state(spark, path)
    return [int(now.whole[2:])] if now else []


def read_published(
    spark: SparkSession, path: str, fmt: str = "parquet", at: State | None = None
) -> DataFrame:
    """A table written by ``publish``, with the rows and changes committed since.

    It is read as it is now, or as it was ``at`` a state. Of changed rows the newest
    commit wins: only the changes are shuffled, and the table's rows meet their keys.
    """
    if fmt == "delta":
        return read_path(spark, path, fmt)
    at = at or state(spark, path)
    if at is None:
        raise FileNotFoundError(f"no published table at {path}")
    whole = read_path(spark, f"{path}/{at.whole}", fmt)
    if not at.rows and not at.changes:
        return whole
    reader = spark.read.format(fmt).schema(whole.schema)
    rows = reader.load([f"{path}/{f}" for f in (at.whole, *[c.folder for c in at.rows])])
    if not at.changes:
        return rows
    changed = _newest_changes(reader, path, at.changes)
    keys = at.changes[-1].keys
    old, new = rows.alias("old"), changed.select(*[named(k) for k in keys]).alias("new")
    same = [F.col(f"old.`{k}`").eqNullSafe(F.col(f"new.`{k}`")) for k in keys]
    return old.join(new, reduce(and_, same), "left_anti").unionByName(changed)


def _newest_changes(reader, path, changes):
    """One row per key out of all change folders, from the largest commit number."""
    rows = reader.load([f"{path}/{c.folder}" for c in changes])
    if len(changes) == 1:
        return rows
    numbers = F.create_map(*[F.lit(v) for c in changes for v in (c.folder, c.number)])
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    keys = changes[-1].keys
    newest = Window.partitionBy(*[named(k) for k in keys]).orderBy(F.col("_commit").desc())
    numbered = rows.select("*", F.element_at(numbers, folder).alias("_commit"))
    first = numbered.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1")
    return first.select(*[named(c) for c in rows.columns])


def ledger_row(
    spark: SparkSession, values: Sequence[tuple], schema: T.StructType
) -> DataFrame:
    """Literal rows under an explicit schema; rows may leave out the last columns.

    For the few rows one run reports. Many models go through ``export_ledger_rows``.
    """
    width = {len(v) for v in values}
    if len(width) != 1:
        raise ValueError("ledger rows differ in length")
    return spark.createDataFrame(list(values), T.StructType(schema.fields[: width.pop()]))
