"""Example rows stored beside a model version for later scoring and monitoring."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgate.columns import named, require_columns
from panelgate.operators.features import FEATURES
from panelgate.storage import scratch_table


def save_example(
    df: DataFrame,
    path: str,
    features: Sequence[str] = FEATURES,
    label: str = "y",
    fmt: str = "parquet",
) -> DataFrame:
    """Write features and label as rows, replacing the model version's example."""
    require_columns(df, *features, label)
    rows = df.select(*[named(f) for f in sorted(features)], named(label))
    rows.write.format(fmt).mode("overwrite").save(path)
    return df.sparkSession.read.format(fmt).load(path)


def to_split_json(
    df: DataFrame,
    columns: Sequence[str],
    group: str = "name",
    json_col: str = "document",
    rows_per_document: int = 1000,
) -> DataFrame:
    """Rows as split JSON documents that ``explode_split_json`` reads back.

    Every document of a group holds exactly ``rows_per_document`` rows but the last one,
    and a rerun gives the same documents. Equal rows are counted, so they are written and
    moved once; the counts before a row in its group say which documents it and its copies
    go to. For that a group is cut into ranges of a hash of its rows, which are summed
    apart: a hot group is neither sorted nor joined in one place. Rows keep no order.
    """
    require_columns(df, group, *columns)
    numbers = [named(c).cast("double") for c in columns]
    rows = df.select(named(group).alias("_group"), F.array(*numbers).alias("_row"))
    # By their text: as numbers, 0.0 and -0.0 would be one row.
    distinct = rows.groupBy("_group", F.to_json("_row").alias("_text")).agg(
        F.first("_row").alias("_row"), F.count("*").alias("_copies")
    )
    placed = _running_copies(scratch_table(distinct, "rows"))
    size = F.lit(rows_per_document)
    first, last = F.col("_before"), F.col("_before") + F.col("_copies") - 1
    dealt = placed.select(
        "_group", "_row", first.alias("_first"), last.alias("_last"),
        F.explode(F.sequence(F.floor(first / size), F.floor(last / size))).alias("_part"),
    )
    here = (F.least(F.col("_last"), (F.col("_part") + 1) * size - 1)
            - F.greatest(F.col("_first"), F.col("_part") * size) + 1)
    gathered = dealt.groupBy("_group", "_part").agg(
        F.array_sort(F.collect_list(F.struct("_row", here.cast("int").alias("_here")))).alias("_found")
    )
    data = F.flatten(F.transform("_found", lambda x: F.array_repeat(x["_row"], x["_here"])))
    names = F.array(*[F.lit(c) for c in columns])
    document = F.to_json(F.struct(names.alias("columns"), data.alias("data")))
    return gathered.select(F.col("_group").alias(group), document.alias(json_col))


def _running_copies(distinct):
    """Add ``_before``: the copies of all rows before this one in its group, by their hash."""
    ranges = 4 * int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = distinct.withColumn("_hash", F.xxhash64("_text")).withColumn(
        "_range", F.pmod(F.shiftrightunsigned("_hash", 33), F.lit(ranges)).cast("int")
    )
    totals = hashed.groupBy("_group", "_range").agg(F.sum("_copies").alias("_here"))
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = totals.select(
        F.col("_group").alias("_of"), F.col("_range").alias("_at"),
        F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_earlier"),
    )
    own = Window.partitionBy("_group", "_range").orderBy("_hash", "_text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inside = hashed.withColumn("_inside", F.sum("_copies").over(own) - F.col("_copies"))
    same = F.col("_group").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at"))
    return inside.join(totals, same).withColumn("_before", F.col("_inside") + F.col("_earlier"))
