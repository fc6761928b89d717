"""From the long indicator table to training tables.

Measurements are combined to one mean per country, date and indicator. From these
come both a date's selected columns and number of indicators and the number its
country uses, so the long table is read and shuffled once, no column is made for an
indicator that is not selected, and nothing passes the driver.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgate.columns import named, required
from panelgate.functions.numbers import quarter_of
from panelgate.operators import features as ft

_DERIVED = ("date", "quarter")


def build_training_table(
    df: DataFrame,
    country: str = "USA",
    features: Sequence[str] = ft.FEATURES,
    y: str = ft.LABEL,
    fillna=0,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Training table of one country; a selected column it never reports is an error.

    A date counts when all indicators of the country are there. ``keys`` may list
    the indicators that are expected: another one is an error, one that is missing
    changes nothing.
    """
    long = ft.fill_missing(ft.to_numeric(ft.filter_country(df, country)), fillna)
    complete = _complete_dates(long, features, y, keys)
    return _selected(complete, features, y, lambda c, name: required(
        c, f"{country} never reports {name}"
    ))


def build_training_tables(
    df: DataFrame,
    features: Sequence[str] = ft.FEATURES,
    y: str = ft.LABEL,
    fillna=0,
) -> DataFrame:
    """Training rows of every country at once, with ``iso_code`` in front.

    A date counts when all indicators its own country uses are there. A country that
    never reports a selected column has no rows; ``countries_lacking`` lists it.
    """
    complete = _complete_dates(_coded(df, fillna), features, y)
    there = F.lit(True)
    for name in _reported(features, y):
        there = there & named(name).isNotNull()
    reported = complete.filter(there)
    return _selected(reported, features, y, lambda c, name: c, "iso_code")


def countries_lacking(
    df: DataFrame, features: Sequence[str] = ft.FEATURES, y: str = ft.LABEL, fillna=0
) -> DataFrame:
    """``(iso_code, missing)``: countries without a selected column, and which they lack."""
    cells = _cells(_coded(df, fillna))
    wanted = _reported(features, y)
    found = cells.groupBy("iso_code").agg(
        *[F.count_if(_clean("indicator") == name).alias(f"n{i}") for i, name in enumerate(wanted)]
    )
    missing = F.array_compact(F.array(
        *[F.when(F.col(f"n{i}") == 0, name) for i, name in enumerate(wanted)]
    ))
    return found.select("iso_code", missing.alias("missing")).filter(F.size("missing") > 0)


def _coded(df, fillna):
    return ft.fill_missing(ft.to_numeric(df.filter(F.col("iso_code").isNotNull())), fillna)


def _reported(features, y):
    return [name for name in dict.fromkeys([*sorted(features), y]) if name not in _DERIVED]


def _clean(c) -> Column:
    return F.replace(F.col(c), F.lit(" "), F.lit("_"))


def _cells(long):
    there = F.col("date").isNotNull() & F.col("indicator").isNotNull() & F.col("value").isNotNull()
    return long.filter(there).groupBy("iso_code", "date", "indicator").agg(
        F.avg("value").alias("mean")
    )


def _complete_dates(long, features, y, keys=None):
    """``iso_code, date`` and the reported columns of dates with all their country's indicators.

    An indicator outside ``keys`` fails the job: leaving it out would keep incomplete
    dates. It is told per country and raised after the join, so in one place only.
    """
    cells = _cells(long)
    picked = []
    for name in _reported(features, y):
        own = _clean("indicator") == name
        clash = F.raise_error(F.lit(f"cleaned column names collide: {name}"))
        picked.append(F.when(F.count_if(own) > 1, clash).otherwise(
            F.max(F.when(own, F.col("mean")))
        ).alias(name))
    dates = cells.groupBy("iso_code", "date").agg(F.count("*").alias("_n"), *picked)
    # A mean is never null here; asking for it keeps both branches on the same shuffle.
    reported = F.when(F.col("mean").isNotNull(), F.col("indicator"))
    unknown = F.lit(None).cast("string")
    if keys is not None:
        unknown = F.max(F.when(~F.col("indicator").isin(list(keys)), F.col("indicator")))
    used = cells.groupBy("iso_code").agg(
        F.count_distinct(reported).alias("_used"), unknown.alias("_unknown")
    )
    problem = F.raise_error(F.concat(F.lit("indicator not in keys: "), F.col("_unknown")))
    return dates.join(used, "iso_code").filter(
        F.when(F.col("_unknown").isNotNull(), problem.cast("boolean"))
        .otherwise(F.col("_n") == F.col("_used"))
    )


def _selected(dates, features, y, checked, *front):
    def column(name):
        if name == "quarter":
            return quarter_of("date").alias(name)
        return named(name) if name in _DERIVED else checked(named(name), name).alias(name)

    label = column(y).alias("y")
    return dates.select(*front, *[column(f) for f in sorted(features)], label)
