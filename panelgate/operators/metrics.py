"""Mean squared errors and the gates built on them. Lower is better."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgate.columns import named
from panelgate.functions.numbers import relative_difference, squared_error

# Fixed value: models closer than this (strictly) count as equally accurate.
TOLERANCE = 0.01


def _mean(errors: Column, grouped: bool) -> Column:
    mean = F.avg(errors)
    if grouped:
        return mean
    empty = F.raise_error(F.lit("no rows to score"))
    return F.when(F.count("*") == 0, empty).otherwise(mean)


def mse(
    df: DataFrame, y: str = "y", y_hat: str = "y_hat", by: Sequence[str] = ()
) -> DataFrame:
    """Mean squared error, over everything or per group (one row per model)."""
    error = _mean(squared_error(y, y_hat), bool(by))
    return df.groupBy(*[named(c) for c in by]).agg(error.alias("mse"))


def score_two(
    df: DataFrame,
    y_hat1: str = "y_hat1",
    y_hat2: str = "y_hat2",
    y: str = "y",
    by: Sequence[str] = (),
) -> DataFrame:
    """Errors of two models on the same rows, in one pass: ``mse1`` and ``mse2``."""
    return df.groupBy(*[named(c) for c in by]).agg(
        _mean(squared_error(y, y_hat1), bool(by)).alias("mse1"),
        _mean(squared_error(y, y_hat2), bool(by)).alias("mse2"),
    )


def with_difference(scores: DataFrame) -> DataFrame:
    """Add ``difference``, relative to the first error; null when that is 0."""
    return scores.withColumn("difference", relative_difference("mse1", "mse2"))


def validate_pair(scores: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """``passed`` when the difference is below the tolerance, else ``failed``."""
    passed = F.col("difference") < tol
    return with_difference(scores).withColumn(
        "outcome", F.when(passed, "passed").otherwise("failed")
    )


def monitor_pair(scores: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """Current (``mse1``) against previous (``mse2``): similar, worse or better.

    A base of 0 leaves the difference undefined, and the outcome with it.
    """
    outcome = (
        F.when(F.col("difference").isNull(), "undefined")
        .when(F.col("difference") < tol, "similar")
        .when(F.col("mse1") > F.col("mse2"), "worse")
        .otherwise("better")
    )
    return with_difference(scores).withColumn("outcome", outcome)


class GateFailed(Exception):
    """A check that stops the pipeline did not hold."""


def assert_valid(gate: DataFrame) -> None:
    """Fail unless every pair passed; counts those that did not and shows up to twenty."""
    failed = gate.filter(F.col("outcome") != "passed")
    shown = failed.limit(20).collect()
    if shown:
        n = len(shown) if len(shown) < 20 else failed.count()
        raise GateFailed(f"{n} models do not match: {[row.asDict() for row in shown]}")
