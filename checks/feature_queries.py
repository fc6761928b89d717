"""Feature operators and the training tables."""

from pyspark.sql import functions as F

from checks import shapes
from checks.registry import query
from panelgate.operators import features as ft
from panelgate.operators.ordering import sort_features, with_position
from panelgate.plans import build_training_table, build_training_tables
from panelgate.plans.training import countries_lacking
from panelgate.sinks import save_training_table
from panelgate.sources import read_indicators

_CELLS = ", ".join(
    f"""avg(value) FILTER (WHERE indicator = '{p}') AS "{p}" """ for p in shapes.PRIORITIES
)
_FILLED_CELLS = _CELLS.replace("avg(value)", "avg(coalesce(value, 0))")
_ALL_CELLS = " AND ".join(f'"{p}" IS NOT NULL' for p in shapes.PRIORITIES)


def _rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def _rounded_cells(columns, digits=4):
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


_TRAINING = f"""
    SELECT round("1-URGENT", 4) AS "1-URGENT", round("2-HIGH", 4) AS "2-HIGH",
           CAST(quarter(CAST("date" AS DATE)) AS INTEGER) AS quarter, round("5-LOW", 4) AS y
    FROM (SELECT "date", {_FILLED_CELLS} FROM {shapes.LONG}
          WHERE iso_code = 'USA' GROUP BY "date")
    WHERE {_ALL_CELLS}"""


def _training(df, **options):
    table = build_training_table(
        df, features=shapes.LONG_FEATURES, y=shapes.LONG_LABEL, **options
    )
    return _rounded(table, ["1-URGENT", "2-HIGH", "y"])


@query(_TRAINING)
def pl1_build_training_table(spark, sf_dir):
    return _training(shapes.long(spark, sf_dir))


@query(_TRAINING)
def pl1_build_training_table_known_keys(spark, sf_dir):
    return _training(shapes.long(spark, sf_dir), keys=shapes.PRIORITIES)


@query(f"""
    WITH wide AS (
      SELECT iso_code, "date", {_FILLED_CELLS}, count(DISTINCT indicator) AS n
      FROM {shapes.LONG_COUNTRIES} GROUP BY iso_code, "date"),
    used AS (
      SELECT iso_code, count(DISTINCT indicator) AS n
      FROM {shapes.LONG_COUNTRIES} GROUP BY iso_code)
    SELECT iso_code, round("1-URGENT", 4) AS "1-URGENT", round("2-HIGH", 4) AS "2-HIGH",
           CAST(quarter(CAST("date" AS DATE)) AS INTEGER) AS quarter, round("5-LOW", 4) AS y
    FROM wide JOIN used USING (iso_code, n)
    WHERE "1-URGENT" IS NOT NULL AND "2-HIGH" IS NOT NULL AND "5-LOW" IS NOT NULL""")
def pl1_build_training_tables_all_countries(spark, sf_dir):
    table = build_training_tables(
        shapes.long_countries(spark, sf_dir),
        features=shapes.LONG_FEATURES,
        y=shapes.LONG_LABEL,
    )
    return _rounded(table, ["1-URGENT", "2-HIGH", "y"])


@query(f"""
    SELECT iso_code, '5-LOW' AS missing FROM {shapes.LONG_COUNTRIES}
    GROUP BY iso_code HAVING count(*) FILTER (WHERE indicator = '5-LOW') = 0""")
def pl1_countries_lacking(spark, sf_dir):
    lacking = countries_lacking(
        shapes.long_countries(spark, sf_dir), shapes.LONG_FEATURES, shapes.LONG_LABEL
    )
    return lacking.select("iso_code", F.array_join("missing", ",").alias("missing"))


@query(f"SELECT * FROM {shapes.LONG} WHERE iso_code = 'USA'")
def pf1_filter_country(spark, sf_dir):
    return ft.filter_country(shapes.long(spark, sf_dir))


@query("""
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey AS DOUBLE) + 0.25 END AS value
    FROM orders""")
def pf2_to_numeric(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.when(key % 4 != 0, F.concat(key.cast("string"), F.lit(".25")))
    orders = shapes.table(spark, sf_dir, "orders")
    return ft.to_numeric(orders.select("o_orderkey", text.alias("value")))


@query(f"""
    SELECT "row id", "date", coalesce("Daily ICU occupancy", 0) AS "Daily ICU occupancy",
           coalesce("Daily hospital occupancy", 0) AS "Daily hospital occupancy",
           "Weekly new hospital admissions", coalesce(remark, '0') AS remark
    FROM {shapes.WIDE}""")
def pf3_fill_missing(spark, sf_dir):
    return ft.fill_missing(shapes.wide(spark, sf_dir), 0)


@query(f"""
    SELECT "row id" AS row_id, "date", "Daily ICU occupancy" AS "Daily_ICU_occupancy",
           "Daily hospital occupancy" AS "Daily_hospital_occupancy",
           "Weekly new hospital admissions" AS "Weekly_new_hospital_admissions", remark
    FROM {shapes.WIDE}""")
def pf4_clean_columns(spark, sf_dir):
    return ft.clean_columns(shapes.wide(spark, sf_dir))


@query(f'SELECT "row id", "Daily ICU occupancy", "date" FROM {shapes.WIDE}')
def pf5_index_to_col(spark, sf_dir):
    wide = shapes.wide(spark, sf_dir).select("date", "row id", "Daily ICU occupancy")
    return ft.index_to_col(wide, "date")


@query(f"""
    SELECT "row id", "date",
           row_number() OVER (ORDER BY "date", "row id") - 1 AS position
    FROM {shapes.WIDE}""")
def pf5_index_to_col_position(spark, sf_dir):
    wide = shapes.wide(spark, sf_dir).select("row id", "date")
    return ft.index_to_col(wide, "position", order=["date", F.col("`row id`")])


@query(f"""
    SELECT * FROM {shapes.WIDE}
    WHERE "Daily ICU occupancy" IS NOT NULL AND "Daily hospital occupancy" IS NOT NULL
      AND remark IS NOT NULL""")
def pf6_drop_incomplete(spark, sf_dir):
    return ft.drop_incomplete(shapes.wide(spark, sf_dir))


@query(f"""
    SELECT *, CAST(quarter(CAST("date" AS DATE)) AS INTEGER) AS quarter FROM {shapes.WIDE}""")
def pf7_with_quarter(spark, sf_dir):
    return ft.with_quarter(shapes.wide(spark, sf_dir))


@query(f"""
    SELECT "Daily ICU occupancy" AS "Daily_ICU_occupancy",
           "Daily hospital occupancy" AS "Daily_hospital_occupancy",
           CAST(quarter(CAST("date" AS DATE)) AS INTEGER) AS quarter,
           "Weekly new hospital admissions" AS "Weekly_new_hospital_admissions"
    FROM {shapes.WIDE}""")
def pf8_select_training(spark, sf_dir):
    wide = ft.with_quarter(ft.clean_columns(shapes.wide(spark, sf_dir)))
    return ft.select_training(wide)


@query(f"""
    SELECT "row id" AS row_id, "Weekly new hospital admissions" AS y FROM {shapes.WIDE}""")
def pf9_rename_label(spark, sf_dir):
    wide = ft.clean_columns(shapes.wide(spark, sf_dir))
    return ft.rename_label(wide.select("row_id", ft.LABEL))


@query(f"""
    SELECT name, round(y_hat1, 4) AS y_hat1, round(y_hat2, 4) AS y_hat2 FROM {shapes.SCORED}""")
def pf10_drop_label(spark, sf_dir):
    return _rounded(ft.drop_label(shapes.scored(spark, sf_dir)), ["y_hat1", "y_hat2"])


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity, l_quantity * 1000.0 + l_tax AS y_hat
    FROM lineitem""")
def pf11_with_predictions(spark, sf_dir):
    lines = shapes.table(spark, sf_dir, "lineitem")
    y_hat = F.col("l_quantity") * 1000.0 + F.col("l_tax")
    return ft.with_predictions(lines, y_hat).select(
        "l_orderkey", "l_linenumber", "l_quantity", "y_hat"
    )


@query(f"""
    SELECT "row id", "date", TIMESTAMP '2023-05-01 12:00:00' AS "timestamp" FROM {shapes.WIDE}""")
def pf12_stamp(spark, sf_dir):
    wide = shapes.wide(spark, sf_dir).select("row id", "date")
    stamped = ft.stamp(wide, as_of="2023-05-01 12:00:00")
    return stamped.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(f"""
    SELECT iso_code, "date", {_rounded_cells(shapes.PRIORITIES)}
    FROM (SELECT iso_code, "date", {_CELLS} FROM {shapes.LONG} GROUP BY iso_code, "date")""")
def ag1_pivot_mean(spark, sf_dir):
    wide = ft.pivot_mean(shapes.long(spark, sf_dir), index=("iso_code", "date"))
    return _rounded(wide, shapes.PRIORITIES)


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
_EVENT_CELLS = ", ".join(
    f"round(avg(value) FILTER (WHERE indicator = '{e}'), 6) AS \"{e}\"" for e in _EVENT_TYPES
)


@query(f"""
    SELECT iso_code, "date", {_EVENT_CELLS} FROM {shapes.LONG_DAILY}
    GROUP BY iso_code, "date" """)
def ag1_pivot_mean_daily(spark, sf_dir):
    wide = ft.pivot_mean(
        shapes.long_daily(spark, sf_dir), index=("iso_code", "date"), keys=_EVENT_TYPES
    )
    return _rounded(wide, _EVENT_TYPES, 6)


@query(f"""
    SELECT "date", {_rounded_cells(shapes.PRIORITIES)}
    FROM (SELECT "date", {_FILLED_CELLS} FROM {shapes.LONG} GROUP BY "date")""")
def ag2_pivot_and_clean(spark, sf_dir):
    wide = ft.pivot_and_clean(shapes.long(spark, sf_dir), 0)
    return _rounded(wide, shapes.PRIORITIES)


_SORT_KEYS = ["Daily_ICU_occupancy", "Daily_hospital_occupancy"]


@query(f"""
    SELECT "Daily ICU occupancy" AS "Daily_ICU_occupancy",
           "Daily hospital occupancy" AS "Daily_hospital_occupancy", "row id" AS row_id,
           row_number() OVER (ORDER BY "Daily ICU occupancy" NULLS LAST,
             "Daily hospital occupancy" NULLS LAST, "row id" NULLS LAST) - 1 AS position
    FROM {shapes.WIDE}""")
def so1_sort_features(spark, sf_dir):
    wide = ft.clean_columns(shapes.wide(spark, sf_dir)).select(*_SORT_KEYS, "row_id")
    return with_position(sort_features(wide, [*_SORT_KEYS, "row_id"]))


@query(f"""
    SELECT "date", indicator, iso_code, value,
           rank() OVER (ORDER BY iso_code, indicator) - 1 AS first,
           rank() OVER (ORDER BY iso_code, indicator) - 2
             + count(*) OVER (PARTITION BY iso_code, indicator) AS last
    FROM {shapes.LONG}""")
def so1_sort_features_hot_copies(spark, sf_dir):
    """Every row with the first and the last position of the rows with its keys."""
    long = shapes.long(spark, sf_dir).drop("entity")
    placed = with_position(sort_features(long, ["iso_code", "indicator"], hot_copies=True))
    ends = placed.groupBy("iso_code", "indicator").agg(
        F.min("position").alias("first"), F.max("position").alias("last")
    )
    return placed.drop("position").join(ends, ["iso_code", "indicator"])


@query(f"SELECT * FROM {shapes.LONG}")
def src1_read_indicators(spark, sf_dir):
    path = shapes.scratch(spark)
    long = shapes.long(spark, sf_dir)
    text = long.withColumn("value", F.coalesce(F.col("value").cast("string"), F.lit("NA")))
    text.write.csv(path, header=True)
    return ft.to_numeric(read_indicators(spark, path))


@query(_TRAINING)
def snk1_save_training_table(spark, sf_dir):
    database = shapes.scratch_database(spark)
    long = shapes.long(spark, sf_dir)
    first = long.select("iso_code", F.col("value").alias("y"))
    save_training_table(first, "m", "1", database)
    return spark.table(save_training_table(_training(long), "m", "1", database))
