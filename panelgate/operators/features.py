"""Long indicator tables to clean, wide training tables."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgate.columns import named, require_columns
from panelgate.functions.numbers import quarter_of, strict_double
from panelgate.operators.ordering import with_position

# Model inputs and label of the training table.
FEATURES = sorted(["Daily_ICU_occupancy", "Daily_hospital_occupancy", "quarter"])
LABEL = "Weekly_new_hospital_admissions"


def filter_country(df: DataFrame, country: str = "USA") -> DataFrame:
    """Rows of one country; rows without a code are dropped."""
    return df.filter(F.col("iso_code") == country)


def to_numeric(df: DataFrame, column: str = "value") -> DataFrame:
    """Make a column double. Null stays null, bad text fails the job."""
    require_columns(df, column)
    c = named(column)
    if isinstance(df.schema[column].dataType, T.NumericType):
        number = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    else:
        number = strict_double(c)
    return df.withColumn(column, number)


def fill_missing(df: DataFrame, value) -> DataFrame:
    """Replace nulls (and NaN) in every column, text columns included."""
    filled = []
    for field in df.schema.fields:
        c, kind = named(field.name), field.dataType.simpleString()
        if kind in ("double", "float"):
            c = F.nanvl(c, F.lit(None).cast(kind))
        filled.append(F.coalesce(c, F.lit(value).cast(kind)).alias(field.name))
    return df.select(*filled)


def indicator_names(df: DataFrame, columns: str = "indicator") -> list[str]:
    """Distinct indicators in name order: one job over one column.

    They become column names; the session's ``spark.sql.pivotMaxValues`` says how many
    columns a pivot may have.
    """
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = (
        df.select(named(columns)).filter(named(columns).isNotNull()).distinct()
        .limit(most + 1).collect()
    )
    if len(found) > most:
        raise ValueError(f"{columns} has more than {most} distinct values")
    return sorted(row[0] for row in found)


def pivot_mean(
    df: DataFrame,
    index: str | Sequence[str] = "date",
    columns: str = "indicator",
    values: str = "value",
    keys: Sequence[str] | None = None,
    ordered: bool = True,
    two_phase: bool = False,
) -> DataFrame:
    """Long to wide; several values of one cell are averaged, absent cells are null.

    ``keys`` lists the wanted columns and saves the job that looks them up. Rows
    without index, indicator or value take no part. A hot index or indicator is
    combined before the shuffle, so it sends one row per input partition. One
    conditional aggregate needs a single shuffle; as it tests every row against each
    column, ``two_phase`` takes Spark's own pivot, which is ahead from some 40 columns.
    """
    by = [index] if isinstance(index, str) else list(index)
    require_columns(df, *by, columns, values)
    if keys is None:
        keys = indicator_names(df.filter(named(values).isNotNull()), columns)
    key, value = named(columns), named(values)
    present = value.isNotNull() & key.isNotNull()
    for name in by:
        present = present & named(name).isNotNull()
    rows = df.filter(present)
    groups = rows.groupBy(*[named(name) for name in by])
    if not keys:
        wide = rows.select(*[named(name) for name in by]).distinct()
    elif not two_phase:
        wide = groups.agg(*[F.avg(F.when(key == k, value)).alias(k) for k in keys])
    else:
        wide = groups.pivot(columns, list(keys)).agg(F.avg(value))
    return wide.orderBy(*[named(name) for name in by]) if ordered else wide


def pivot_and_clean(df: DataFrame, fillna=0, **pivot) -> DataFrame:
    """Numeric cast, then fill, then pivot: a null measurement counts in the mean."""
    return pivot_mean(fill_missing(to_numeric(df), fillna), **pivot)


def clean_columns(df: DataFrame) -> DataFrame:
    """Spaces in column names become ``_``; two equal names afterwards are an error."""
    names = [name.replace(" ", "_") for name in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"cleaned column names collide: {clashes}")
    return df.toDF(*names)


def index_to_col(
    df: DataFrame, name: str, order: Sequence[str | Column] | None = None
) -> DataFrame:
    """Index as the last column: the group key ``name``, else the position under ``order``."""
    if name in df.columns:
        return df.select(*[named(c) for c in df.columns if c != name], named(name))
    if not order:
        raise ValueError(f"{name} is no column, so an explicit order is needed")
    return with_position(df, *order, name=name)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Keep rows that have a value in every column."""
    return df.dropna("any")


def with_quarter(df: DataFrame, date: str = "date") -> DataFrame:
    """All columns plus ``quarter`` (1-4); a bad date fails the job."""
    require_columns(df, date)
    return df.select("*", quarter_of(date).alias("quarter"))


def select_training(
    df: DataFrame, features: Iterable[str] = FEATURES, y: str = LABEL
) -> DataFrame:
    """Features in name order, then the label."""
    return df.select(*[named(f) for f in sorted(features)], named(y))


def rename_label(df: DataFrame, y: str = LABEL, to: str = "y") -> DataFrame:
    require_columns(df, y)
    return df.withColumnRenamed(y, to)


def drop_label(df: DataFrame, y: str = "y") -> DataFrame:
    """Model inputs only. A missing label is an error."""
    require_columns(df, y)
    return df.drop(y)


def with_predictions(df: DataFrame, y_hat: Column, name: str = "y_hat") -> DataFrame:
    """Input columns plus the predictions."""
    return df.withColumn(name, y_hat)


def stamp(df: DataFrame, as_of=None, name: str = "timestamp") -> DataFrame:
    """Add the time of the run, or the given one for repeatable output."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return df.withColumn(name, now)

