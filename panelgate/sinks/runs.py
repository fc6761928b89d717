"""Parameters and metrics of model runs."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgate.columns import named
from panelgate.schemas import RUN_VALUES
from panelgate.sinks.tables import append_merge


def run_values(
    df: DataFrame, params: Sequence[str] = (), metrics: Sequence[str] = ()
) -> DataFrame:
    """One row per value out of one row per run: ``run_id, kind, key, value``."""
    kinds = [(p, "param") for p in params] + [(m, "metric") for m in metrics]
    if not kinds:
        raise ValueError("name at least one parameter or metric")
    values = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(key).alias("key"),
                named(key).cast("double").alias("value"),
            )
            for key, kind in kinds
        ]
    )
    return df.select("run_id", F.inline(values))


def log_run_values(
    df: DataFrame, table: str, params: Sequence[str] = (), metrics: Sequence[str] = ()
) -> DataFrame:
    """Append the values of many runs (one row each) to the run-value table."""
    return append_merge(run_values(df, params, metrics), table)


def log_values(
    spark: SparkSession,
    table: str,
    run_id: str,
    params: Mapping[str, float] | None = None,
    metrics: Mapping[str, float] | None = None,
) -> DataFrame:
    """Append the values of one run."""
    rows = [
        (run_id, kind, key, float(value))
        for kind, values in (("param", params), ("metric", metrics))
        for key, value in (values or {}).items()
    ]
    return append_merge(spark.createDataFrame(rows, RUN_VALUES), table)
