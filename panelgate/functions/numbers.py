"""Numeric and calendar expressions."""

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelgate.columns import as_column, converted


def strict_double(c) -> Column:
    """Text or number as double. Null and NaN become null, bad text is an error."""
    c = as_column(c)
    text = F.rtrim(c.cast("string"))
    number = c.try_cast("double")
    finite = F.abs(number) <= F.lit(sys.float_info.max)
    # The JVM parser also takes type suffixes and hexadecimal, which are not numbers here.
    jvm_only = (F.substring(text, -1, 1).isin("d", "D", "f", "F") & finite) | (
        F.contains(F.lower(text), F.lit("0x"))
    )
    number = F.when(number.isNotNull() & ~jvm_only, number)
    return F.nanvl(converted(c, number, "not a number"), F.lit(None).cast("double"))


def version_number(c) -> Column:
    """Version text as a number, so that 10 comes after 9."""
    c = as_column(c)
    return converted(c, c.try_cast("bigint"), "not a version number")


def quarter_of(c) -> Column:
    """Quarter (1-4) of a ``yyyy-MM-dd`` text or a date."""
    c = as_column(c)
    return F.quarter(converted(c, c.try_cast("date"), "not a date"))


def relative_difference(base, other) -> Column:
    """``|(base - other) / base|``; null when the base is 0."""
    base, other = as_column(base), as_column(other)
    return F.abs(F.try_divide(base - other, base))


def squared_error(y, y_hat) -> Column:
    """Squared error of one row. Null, NaN and infinite inputs are errors."""
    difference = as_column(y) - as_column(y_hat)
    largest = sys.float_info.max
    return F.when(
        difference.between(F.lit(-largest), F.lit(largest)), difference * difference
    ).otherwise(F.raise_error(F.lit("label or prediction is null or not finite")))
