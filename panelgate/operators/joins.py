"""Joins of a table that may have a hot key with a table of one row per key."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgate.columns import named
from panelgate.storage import scratch_table

# A lookup with at most so many rows after every salt has repeated it is repeated whole.
FEW_REPEATED = 200_000


def spread_join(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], salts: int | None = None
) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (unique on ``keys``), split by a salt.

    Every input partition of ``rows`` takes one of ``salts`` parts, so a key that
    holds a third of all rows is joined in that many tasks. The salt depends on the
    partition number alone: a task that runs again after a lost executor sends its
    rows to the same places. There are as many salts as shuffle partitions unless
    the caller says otherwise, so a part of a hot key is no larger than a part of
    all rows. A short ``lookup`` is repeated once per salt, and whether that is small
    enough to broadcast is left to Spark's size check. Of a longer one only hot keys are
    repeated, those with more than a salt's share of the rows: the rows are counted by
    key first, and as Spark's size check does not see repetitions, it is not asked.
    """
    if salts is None:
        salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if salts == 1:
        return rows.join(lookup, list(keys))
    few = FEW_REPEATED // salts
    if lookup.limit(few + 1).count() <= few:
        parts = F.lit(salts)
        return _salted(rows, parts).join(_repeated(lookup, parts), [*keys, "_salt"]).drop("_salt")
    hot = F.broadcast(_hot_keys(rows, keys, salts))
    parts = F.coalesce("_parts", F.lit(1))
    salted = _salted(rows.join(hot, list(keys), "left"), parts).drop("_parts")
    repeated = _repeated(lookup.join(hot, list(keys), "left"), parts).drop("_parts")
    return salted.join(repeated.hint("merge"), [*keys, "_salt"]).drop("_salt")


def _salted(rows, parts):
    return rows.withColumn("_salt", F.pmod(F.spark_partition_id(), parts))


def _repeated(lookup, parts):
    return lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))


def _hot_keys(rows, keys, salts):
    """Keys with more than a salt's share of the rows, fewer than ``salts``, and their ``_parts``.

    The counts are written down once, so both sides of the join go by the same ones.
    """
    by = [named(k) for k in keys]
    counted = scratch_table(rows.groupBy(*by).count(), "counts")
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).head()[0]
    hot = counted.filter(F.col("count") * salts > total)
    return hot.select(*by, F.ceil(F.col("count") * salts / F.lit(max(total, 1))).cast("int").alias("_parts"))
