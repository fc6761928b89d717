"""Column access and checks that do not depend on session settings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """Column of exactly this name, whatever characters it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(c) -> Column:
    return named(c) if isinstance(c, str) else c


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing, the table has {df.columns}")


def converted(source: Column, result: Column, what: str) -> Column:
    """``result`` where it is there; null stays null; anything else fails the job.

    Written out instead of a plain cast so that bad text is an error also in
    sessions that switched ANSI mode off.
    """
    problem = F.concat(F.lit(f"{what}: "), source.cast("string"))
    return F.coalesce(result, F.when(source.isNotNull(), F.raise_error(problem)))


def required(value: Column, message: str) -> Column:
    """``value``, failing the job where it is null."""
    return F.coalesce(value, F.raise_error(F.lit(message)))
