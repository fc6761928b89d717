"""Sorted tables, positions and newest rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgate.columns import as_column, named, require_columns
from panelgate.storage import shared_dir


def _row_hash(df):
    """Last sort key: splits rows with equal keys over partitions, copies excepted."""
    return F.xxhash64(*[named(c) for c in df.columns])


def sort_features(df: DataFrame, cols: Sequence[str], hot_copies: bool = False) -> DataFrame:
    """Ascending sort on several columns, nulls last.

    A hash of the whole row breaks ties, so that many rows with equal keys are
    split over range partitions. Exact copies of one row stay together; when they
    can make up a large share of the table, ``hot_copies`` counts them before the
    sort and writes them out again, in bounded pieces, after it.
    """
    require_columns(df, *cols)
    keys = [named(c).asc_nulls_last() for c in cols]
    whole_row = _row_hash(df)
    if not hot_copies:
        return df.orderBy(*keys, whole_row)
    piece = 100_000
    counted = df.groupBy(*[named(c) for c in df.columns]).agg(F.count("*").alias("_copies"))
    pieces = counted.select(
        "*",
        F.explode(
            F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(piece).cast("bigint"))
        ).alias("_start"),
    )
    in_order = pieces.orderBy(*keys, whole_row, F.col("_start"))
    repeats = F.least(F.col("_copies") - F.col("_start"), F.lit(piece)).cast("int")
    return in_order.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), repeats))
    ).select(*[named(c) for c in df.columns])


def with_position(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """Exact 0-based position of every row under ascending ``order``, nulls first.

    Ties go by a hash of the row. Rows are dealt to ranges of the order, counted there and
    numbered from the counts before: one shuffle, no single-task window and no stored copy.
    Without ``order``, ``df`` has to be sorted already; then, and with sort expressions
    like ``desc()``, the sorted table is written to the checkpoint folder once, as its
    ranges cannot be told from outside.
    """
    keys = [as_column(c) for c in order]
    if not order or any(_is_sort(k) for k in keys):
        return _numbered_as_sorted(df.orderBy(*keys, _row_hash(df)) if order else df, name)
    return running_sum(df, [], [*keys, _row_hash(df)], name=name)


def _is_sort(column):
    """Whether a column is a sort expression; one that only is called so counts, too."""
    return str(column).endswith((" NULLS FIRST'>", " NULLS LAST'>"))


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    weight: str | Column | None = None,
    name: str = "position",
) -> DataFrame:
    """Add the sum of ``weight`` (of 1 without it) over the rows before, in every group of ``by``.

    ``order`` is ascending, nulls first, and has to tell rows apart that must not be
    swapped. Ranges of (group, order) are fixed once from a sample of bounded size; every
    (range, group) is summed where it lies. Only a group that goes over a range's end, one
    per end at most, needs what stands before: these sums, two per range, pass the driver.
    So a group with a third of all rows is spread over a third of the ranges. Three jobs run
    here, over the columns of ``by`` and ``order``; the result is lazy. ``df`` has to give
    the same rows each time it is evaluated.
    """
    own = df.withColumn("_order", F.struct(*[
        as_column(c).alias(f"o{i}") for i, c in enumerate(order)
    ]))
    own = own.withColumn("_weight", F.lit(1) if weight is None else as_column(weight))
    groups = [named(c) for c in by]
    fields = [f for c in by for f in _comparable(own, c)]
    inner = own.schema["_order"].dataType.fields
    fields += [f for i in inner for f in _comparable(own, f"_order.{i.name}", i.dataType)]
    keyed = own.withColumn("_key", F.struct(*[f.alias(f"k{i}") for i, f in enumerate(fields)]))
    bounds = _range_bounds(keyed)
    ranged = _with_range(keyed, bounds)
    n_groups = sum(len(_comparable(own, c)) for c in by)
    within = Window.partitionBy("_range", *groups).orderBy("_order").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = F.sum("_weight").over(within) - F.col("_weight")
    summed = ranged.withColumn("_before", before.cast("bigint"))
    earlier = _earlier(ranged, bounds, n_groups)
    same = F.col("_range") == F.col("_at")
    for key, end in _group_keys(n_groups):
        same &= key.eqNullSafe(end)
    # Two rows per range at most: a bounded broadcast.
    summed = summed.join(F.broadcast(earlier), same, "left")
    added = F.coalesce("_earlier", F.lit(0))
    return summed.select(
        *[named(c) for c in df.columns], (F.col("_before") + added).alias(name)
    )


def _comparable(df, c, kind=None):
    """``c`` as one or more values of the same order that are also literals of Python."""
    column = as_column(c) if kind is None else F.col(c)
    kind = kind or df.schema[c].dataType
    if isinstance(kind, T.TimestampType):
        return [F.unix_micros(column)]
    if isinstance(kind, T.TimestampNTZType):
        return [F.unix_date(column.cast("date")), F.date_format(column, "HH:mm:ss.SSSSSS")]
    if isinstance(kind, T.DateType):
        return [F.unix_date(column)]
    return [column]


def _range_bounds(keyed):
    """Keys that part the rows into as many ranges as a shuffle has partitions, about evenly.

    Tasks draw their share of some 32 keys a range; no task gets the drawn keys of all others
    before they are that few.
    """
    spark = keyed.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, 32 * n / max(1, keyed.count()))
    drawn = keyed.select("_key").sample(share, seed=17)
    rows = [r["_key"] for r in drawn.orderBy("_key").collect()]
    found = [rows[len(rows) * i // n] for i in range(1, n)] if rows else []
    return list(dict.fromkeys(found))


def _literal(row, kind):
    values = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields)]
    return F.struct(*values)


def _with_range(keyed, bounds):
    """Add ``_range``: how many bounds are not above the row's key, by binary search."""
    kind = keyed.schema["_key"].dataType
    ranged = keyed.withColumn("_range", F.lit(0))
    if not bounds:
        return ranged
    known = F.array(*[_literal(b, kind) for b in bounds])
    half = 1 << (len(bounds).bit_length() - 1)
    while half:
        reached = F.get(known, F.col("_range") + (half - 1)) <= F.col("_key")
        ranged = ranged.withColumn(
            "_range", F.col("_range") + F.when(reached, half).otherwise(0)
        )
        half //= 2
    return ranged


def _group_keys(n_groups):
    """The group's values in a row's key, each with the column it is looked up by."""
    return [(F.col(f"_key.k{i}"), F.col(f"_end{i}")) for i in range(n_groups)]


def _earlier(ranged, bounds, n_groups):
    """``_at, _end0, ..., _earlier``: sums before the ranges that a group goes on in."""
    spark = ranged.sparkSession
    fields = ranged.schema["_key"].dataType.fields[:n_groups]
    ends = [T.StructField(f"_end{i}", f.dataType) for i, f in enumerate(fields)]
    found, running = [], {}
    if bounds:
        crossing = ranged.select(
            "_range", "_weight", *[key.alias(f"_of{i}") for i, (key, _) in enumerate(_group_keys(n_groups))]
        )
        if n_groups:
            # One group per bound at most.
            values = list(dict.fromkeys(tuple(b)[:n_groups] for b in bounds))
            same = F.lit(True)
            for i in range(n_groups):
                same &= F.col(f"_of{i}").eqNullSafe(F.col(f"_end{i}"))
            wanted = spark.createDataFrame(values, T.StructType(ends))
            crossing = crossing.join(F.broadcast(wanted), same, "left_semi")
        of = [f"_of{i}" for i in range(n_groups)]
        sums = crossing.groupBy("_range", *of).agg(F.sum("_weight").alias("s")).collect()
        for r in sorted(sums, key=lambda r: r["_range"]):
            own = tuple(r)[1:-1]
            # By its text, as one NaN is not equal to another.
            so_far = running.get(repr(own), 0)
            if so_far:
                found.append((r["_range"], *own, so_far))
            running[repr(own)] = so_far + int(r["s"])
    schema = [T.StructField("_at", T.IntegerType()), *ends, T.StructField("_earlier", T.LongType())]
    return spark.createDataFrame(found, T.StructType(schema))


def _numbered_as_sorted(df, name):
    shared_dir(df.sparkSession)
    ranked = df.checkpoint()
    part = F.spark_partition_id()
    sizes = dict(ranked.groupBy(part.alias("part")).count().collect())
    offsets, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(i, 0)
    if not offsets:
        return ranked.withColumn(name, F.lit(0).cast("bigint"))
    in_partition = F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)
    known = F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>")
    offset = F.get(known, part)
    return ranked.withColumn(name, offset + in_partition)


def newest_first(df: DataFrame, time: str = "timestamp", *ties: str) -> DataFrame:
    """Ledger rows by time, latest first; ``ties`` order rows of one moment."""
    return df.orderBy(named(time).desc_nulls_last(), *[named(t) for t in ties], _row_hash(df))


def latest_row(df: DataFrame, time: str = "timestamp", *ties: str) -> DataFrame:
    """The newest row. Each partition keeps one row, nothing is sorted as a whole."""
    return newest_first(df, time, *ties).limit(1)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run of every run name; of runs of one moment the smallest ``run_id``.

    Both steps are combined by hashing before their shuffles.
    """
    newest = runs.groupBy("run_name").agg(F.max("start_time").alias("start_time"))
    same = F.col("r.run_name").eqNullSafe(F.col("n.run_name")) & F.col(
        "r.start_time"
    ).eqNullSafe(F.col("n.start_time"))
    tied = runs.alias("r").join(newest.alias("n"), same).select("r.*")
    return tied.groupBy("run_name", "start_time").agg(F.min("run_id").alias("run_id")).select(
        "run_name", "run_id", "start_time"
    )


def latest_run(runs: DataFrame, run_name: str) -> DataFrame:
    """Newest run with this name, by the order of ``latest_runs``."""
    return latest_row(runs.filter(F.col("run_name") == run_name), "start_time", "run_id")
