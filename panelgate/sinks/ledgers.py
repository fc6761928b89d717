"""Append-only ledgers of exports and imports, kept as published path tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgate.columns import named
from panelgate.commits import commit
from panelgate.sinks.tables import publish, stage_rows, update_published
from panelgate.sources.tables import published_versions, read_published
from panelgate.storage import exists


def ensure_ledger(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> tuple[bool, str]:
    """Whether the ledger was there, and its path; an empty typed one is made if not."""
    if fmt == "delta":
        existed = exists(spark, f"{path}/_delta_log")
    else:
        existed = bool(published_versions(spark, path))
    if not existed:
        publish(spark.createDataFrame([], schema), path, fmt)
    return existed, path


def append_to_ledger(
    spark: SparkSession, path: str, rows: DataFrame, fmt: str = "parquet"
) -> DataFrame:
    """Add rows and return the whole ledger.

    Rows that fit the ledger's columns are committed as new files. When they bring new
    columns, old and new rows are published together under the merged schema, again if
    another writer was faster. So any number of writers may add at a time.
    """
    if fmt == "delta":
        fitted(rows, read_published(spark, path, fmt)).write.format(fmt).mode("append").save(path)
        return read_published(spark, path, fmt)
    old = read_published(spark, path, fmt)
    known = {f.name: f.dataType for f in old.schema.fields}
    if all(known.get(f.name) == f.dataType for f in rows.schema.fields):
        commit(spark, path, "rows", stage_rows(fitted(rows, old), path, fmt=fmt))
    else:
        update_published(
            spark, path, lambda now: now.unionByName(rows, allowMissingColumns=True), fmt
        )
    return read_published(spark, path, fmt)


def fitted(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` in the columns of ``table``; missing ones are null."""
    return rows.select(
        *[
            named(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
    )
