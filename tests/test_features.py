"""Feature operators on small tables with every special case."""

import datetime
import os
import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelgate.functions import strict_double
from panelgate.operators import features as ft
from panelgate.operators.ordering import running_sum, sort_features, with_position
from panelgate.plans import build_training_table, build_training_tables
from panelgate.plans import training
from panelgate.schemas import INDICATORS
from panelgate.sources import read_indicators

NAMES = [
    "Daily ICU occupancy",
    "Daily ICU occupancy per million",
    "Daily hospital occupancy",
    "Daily hospital occupancy per million",
    "Weekly new hospital admissions",
    "Weekly new hospital admissions per million",
]


@pytest.fixture(scope="module")
def raw(spark):
    """Two countries, one date each, one missing value."""
    rows = []
    for entity, code, date, base in [
        ("United States", "USA", "2022-04-17", 100.0),
        ("Algeria", "DZA", "2022-04-18", 200.0),
    ]:
        for i, name in enumerate(NAMES):
            missing = code == "USA" and i == 0
            rows.append((entity, code, date, name, None if missing else str(base + i)))
    return spark.createDataFrame(rows, INDICATORS)


def long(spark, rows):
    columns = "iso_code string, date string, indicator string, value string"
    return spark.createDataFrame(rows, columns)


def records(df):
    return sorted(tuple(row) for row in df.collect())


def test_filter_keeps_one_country(spark, raw):
    usa = ft.filter_country(raw)
    assert usa.columns == raw.columns
    assert {row.iso_code for row in usa.collect()} == {"USA"}
    with_null = long(spark, [(None, "2022-01-01", "a", "1"), ("USA", "2022-01-01", "a", "1")])
    assert ft.filter_country(with_null).count() == 1


def test_pivot_fills_the_missing_value(raw):
    first = ft.pivot_and_clean(raw, 0).collect()[0]
    assert first["date"] == "2022-04-17"
    assert first["Daily ICU occupancy"] == 0


def test_no_cleaned_name_has_a_space(spark):
    frame = spark.createDataFrame([tuple(range(6))], NAMES)
    assert not [c for c in ft.clean_columns(frame).columns if " " in c]


def test_index_becomes_the_last_column(raw):
    wide = ft.pivot_and_clean(raw, 0)
    indexed = ft.index_to_col(wide, "date")
    assert indexed.columns == sorted(NAMES) + ["date"]
    assert [r.date for r in indexed.collect()] == [r.date for r in wide.collect()]


def test_position_index_needs_an_order(spark):
    letters = spark.createDataFrame([("b",), ("a",), ("c",)], "letter string").repartition(3)
    with pytest.raises(ValueError):
        ft.index_to_col(letters, "index")
    placed = ft.index_to_col(letters, "index", order=["letter"])
    assert records(placed) == [("a", 0), ("b", 1), ("c", 2)]


def test_positions_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a int")
    assert with_position(empty, "a").collect() == []


def test_bad_text_is_an_error_and_null_is_not(spark):
    good = long(spark, [("USA", "2022-01-01", "a", " 1e3 "), ("USA", "2022-01-01", "a", None)])
    assert [r.value for r in ft.to_numeric(good).collect()] == [1000.0, None]
    for text in ("abc", "1d", "2.5f", "0x10"):
        bad = long(spark, [("USA", "2022-01-01", "a", text)])
        with pytest.raises(PySparkException):
            ft.to_numeric(bad).collect()


def test_bad_text_is_an_error_without_ansi_too(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(PySparkException):
            ft.to_numeric(long(spark, [("USA", "2022-01-01", "a", "abc")])).collect()
        with pytest.raises(PySparkException):
            ft.with_quarter(spark.createDataFrame([("no date",)], "date string")).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_infinite_text_is_a_number(spark):
    df = spark.createDataFrame([("inf",), ("-Infinity",)], "v string")
    assert [r[0] for r in df.select(strict_double("v")).collect()] == [float("inf"), -float("inf")]


def test_fill_covers_text_columns_and_nan(spark):
    df = spark.createDataFrame(
        [(None, None, None), ("x", float("nan"), 3)], "a string, b double, c int"
    )
    filled = ft.fill_missing(df, 0)
    assert filled.schema.simpleString() == df.schema.simpleString()
    assert records(filled) == [("0", 0.0, 0), ("x", 0.0, 3)]


def test_null_counts_as_zero_but_an_absent_cell_drops_the_row(spark):
    df = long(spark, [
        ("USA", "2022-01-01", "a", None), ("USA", "2022-01-01", "a", "10"),
        ("USA", "2022-01-01", "b", "1"), ("USA", "2022-02-01", "a", "3"),
    ])
    wide = ft.pivot_and_clean(df, 0)
    assert records(wide.fillna(-1)) == [("2022-01-01", 5.0, 1.0), ("2022-02-01", 3.0, -1.0)]
    assert records(ft.drop_incomplete(wide)) == [("2022-01-01", 5.0, 1.0)]


def test_null_indicator_becomes_column_0(spark):
    df = long(spark, [("USA", "2022-01-01", None, "4"), ("USA", "2022-01-01", "a", "1")])
    wide = ft.pivot_and_clean(df, 0)
    assert wide.columns == ["date", "0", "a"]
    assert wide.collect()[0]["0"] == 4.0


def test_pivot_without_fill_leaves_out_what_has_no_value(spark):
    df = long(spark, [
        ("USA", "2022-01-01", "a", "1"), ("USA", "2022-01-02", "a", None),
        ("USA", "2022-01-01", "b", None), ("USA", "2022-01-01", None, "9"),
    ])
    wide = ft.pivot_mean(ft.to_numeric(df))
    assert wide.columns == ["date", "a"]
    assert records(wide) == [("2022-01-01", 1.0)]


def test_two_phase_pivot_gives_the_same(spark):
    rows = [("USA", f"2022-01-{d:02d}", f"i.{i} `x`", str(d * i)) for d in range(1, 6)
            for i in range(1, 8) if (d + i) % 4]
    df = ft.to_numeric(long(spark, rows))
    few = ft.pivot_mean(df)
    many = ft.pivot_mean(df, two_phase=True)
    assert few.columns == many.columns
    assert few.collect() == many.collect()


def test_pivot_of_nothing_has_only_its_index(spark):
    wide = ft.pivot_and_clean(long(spark, []), 0)
    assert wide.columns == ["date"]
    assert wide.collect() == []


def test_colliding_names_are_an_error(spark):
    with pytest.raises(ValueError):
        ft.clean_columns(spark.createDataFrame([(1, 2)], ["a b", "a_b"]))


def test_quarters(spark):
    dates = spark.createDataFrame(
        [("2022-01-01",), ("2022-06-30",), ("2022-07-01",), ("2022-12-31",)], "date string"
    )
    assert [r.quarter for r in ft.with_quarter(dates).collect()] == [1, 2, 3, 4]
    with pytest.raises(PySparkException):
        ft.with_quarter(spark.createDataFrame([("0",)], "date string")).collect()


def test_missing_label_is_an_error(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        ft.drop_label(df)
    with pytest.raises(ValueError):
        ft.rename_label(df)


def test_features_are_in_code_point_order():
    assert ft.FEATURES == ["Daily_ICU_occupancy", "Daily_hospital_occupancy", "quarter"]


def country(code, dates, names, skip=()):
    return [
        (code, date, name, str(i + len(date)))
        for date in dates for i, name in enumerate(names) if (date, name) not in skip
    ]


DATES = ["2022-01-01", "2022-05-01", "2022-09-01"]


def three_countries(spark):
    lacking = [n for n in NAMES if "per million" not in n]
    return long(
        spark,
        country("USA", DATES, NAMES, skip={(DATES[1], NAMES[5])})
        + country("DZA", DATES, lacking)
        + country("FRA", DATES, NAMES)
        + [(None, DATES[0], NAMES[0], "1")],
    )


def test_all_countries_equal_each_country_alone(spark):
    df = three_countries(spark)
    together = build_training_tables(df)
    assert together.columns == ["iso_code", *ft.FEATURES, "y"]
    assert together.count() == 2 + 3 + 3
    for code in ("USA", "DZA", "FRA"):
        alone = build_training_table(df, code)
        own = together.filter(F.col("iso_code") == code).drop("iso_code")
        assert records(alone) == records(own)


def test_country_without_a_selected_column_has_no_rows(spark):
    unlabelled = [n for n in NAMES if n.replace(" ", "_") != ft.LABEL]
    df = long(spark, country("USA", DATES, NAMES) + country("DZA", DATES, unlabelled))
    together = build_training_tables(df)
    assert {r.iso_code for r in together.collect()} == {"USA"}
    assert together.filter("y is null").count() == 0
    lacking = training.countries_lacking(df).collect()
    assert [(r.iso_code, r.missing) for r in lacking] == [("DZA", [ft.LABEL])]
    with pytest.raises(PySparkException, match="DZA never reports"):
        build_training_table(df, "DZA").collect()


def test_selected_names_that_collide_are_an_error(spark):
    df = long(spark, country("USA", DATES, [*NAMES, ft.LABEL]))
    with pytest.raises(PySparkException, match="collide"):
        build_training_table(df).collect()


def test_known_keys_may_be_more_than_there_are(spark):
    df = three_countries(spark)
    keys = [*NAMES, "never reported"]
    assert records(build_training_table(df, keys=keys)) == records(build_training_table(df))


def test_known_keys_must_be_complete(spark):
    df = three_countries(spark)
    assert records(build_training_table(df, keys=NAMES)) == records(build_training_table(df))
    with pytest.raises(PySparkException):
        build_training_table(df, keys=[NAMES[0], NAMES[2], NAMES[4]]).collect()


def test_training_table_equals_pandas(spark):
    dice = random.Random(1)
    rows = [
        (dice.choice(["USA", "DZA"]), f"2022-{dice.randint(1, 12):02d}-01", dice.choice(NAMES),
         None if i % 11 == 0 else str(i * 1.5))
        for i in range(300)
    ]
    df = long(spark, rows)
    pdf = pd.DataFrame(rows, columns=df.columns)
    pdf = pdf[pdf.iso_code == "USA"].assign(value=lambda d: pd.to_numeric(d["value"]))
    wide = pdf.fillna(0).pivot_table(values="value", columns="indicator", index="date").dropna()
    wide.columns = wide.columns.str.replace(" ", "_")
    wide["quarter"] = pd.to_datetime(wide.index).quarter
    expected = sorted(map(tuple, wide[ft.FEATURES + [ft.LABEL]].to_numpy().tolist()))
    found = records(build_training_table(df))
    assert 0 < len(found) < 12
    assert len(found) == len(expected)
    for row, other in zip(found, expected):
        assert row == pytest.approx(other)


def test_sort_puts_nulls_last_and_keeps_copies(spark):
    rows = [(2, None), (1, "b"), (None, "a"), (1, None), (1, "b"), (1, "a")] * 3
    df = spark.createDataFrame(rows, "k int, v string").repartition(4)
    expected = [(1, "a")] * 3 + [(1, "b")] * 6 + [(1, None)] * 3 + [(2, None)] * 3 + [(None, "a")] * 3
    for hot_copies in (False, True):
        ordered = sort_features(df, ["k", "v"], hot_copies)
        assert [tuple(r) for r in ordered.collect()] == expected


def test_positions_are_exact_over_many_partitions(spark):
    df = spark.range(0, 10_000, 1, 16).select((F.col("id") * 7919 % 10_007).alias("k"))
    keys = sorted((r.k for r in df.collect()), reverse=True)
    for ranked in (
        with_position(df, F.col("k").desc()), with_position(df.orderBy(F.col("k").desc()))
    ):
        assert {r.k: r.position for r in ranked.collect()} == {k: i for i, k in enumerate(keys)}


def test_indicator_file(spark, tmp_path):
    path = tmp_path / "indicators.csv"
    path.write_text(
        "entity,iso_code,date,indicator,value\n"
        'A,USA,2022-01-01,"Daily, ""ICU""",NA\n'
        "B,N/A,2022-01-02,b,1.5\n"
        ",null,2022-01-03,c,\n"
    )
    df = read_indicators(spark, str(path))
    assert {t for _, t in df.dtypes} == {"string"}
    assert [tuple(r) for r in df.collect()] == [
        ("A", "USA", "2022-01-01", 'Daily, "ICU"', None),
        ("B", None, "2022-01-02", "b", "1.5"),
        (None, None, "2022-01-03", "c", None),
    ]


def test_indicator_file_with_line_breaks(spark, tmp_path):
    path = tmp_path / "indicators.csv"
    path.write_text('date,indicator,value\n2022-01-01,"a\nb",1\n2022-01-02,c,nan\n')
    df = read_indicators(spark, str(path), multi_line=True)
    assert [tuple(r) for r in df.collect()] == [
        ("2022-01-01", "a\nb", "1"), ("2022-01-02", "c", None),
    ]


def test_indicator_files_with_other_headers_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,indicator,value\n2022-01-01,a,1\n")
    (tmp_path / "b.csv").write_text("indicator,date,value\na,2022-01-01,1\n")
    with pytest.raises(Exception, match="header does not conform"):
        read_indicators(spark, str(tmp_path)).collect()


def test_country_filter_and_columns_reach_the_scan(spark, raw, tmp_path):
    path = str(tmp_path / "long")
    raw.write.parquet(path)
    table = build_training_table(spark.read.parquet(path), keys=NAMES)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(iso_code,USA)" in plan
    assert "entity" not in plan.split("ReadSchema")[1]
    table.collect()
    final = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # Dates and the country's number of indicators come from one shuffle of the long table.
    assert "ReusedExchange" in final


cells = st.dictionaries(
    st.tuples(st.sampled_from(["2022-01-01", "2022-02-01", "2022-03-01"]),
              st.sampled_from(["a", "b", "c d"])),
    st.floats(-1e6, 1e6), min_size=1,
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(cells)
def test_pivot_of_unique_cells_can_be_undone(spark, table):
    rows = [("USA", date, name, repr(value)) for (date, name), value in table.items()]
    wide = ft.pivot_mean(ft.to_numeric(long(spark, rows)))
    names = [c for c in wide.columns if c != "date"]
    melted = wide.unpivot(["date"], [f"`{n}`" for n in names], "indicator", "value")
    back = {(r.date, r.indicator): r.value for r in melted.collect() if r.value is not None}
    assert back == table


def test_positions_leave_no_copy_behind(spark):
    folder = spark.conf.get("spark.checkpoint.dir")

    def stored():
        return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}

    df = spark.range(0, 5000, 1, 5).select((F.col("id") * 7919 % 5000).alias("k"))
    before = stored()
    placed = with_position(df, "k")
    assert placed.filter("position <> k").count() == 0
    assert stored() == before


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 300), st.integers(0, 1000), st.integers(1, 6))
def test_running_sums_equal_a_window(spark, n, seed, parts):
    dice = random.Random(seed)
    start = datetime.datetime(2024, 3, 30)
    rows = [
        (dice.choice(["hot"] * 5 + ["a", None, 'q"']), dice.choice([None, 1.5, -0.0, float("nan")]),
         start + datetime.timedelta(hours=dice.randint(0, 99)), i, dice.randint(0, 3))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "g string, x double, t timestamp, i long, w int").repartition(parts)
    for by in ([], ["g"]):
        for order in (["x", "i"], ["t", "i"]):
            own = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            expected = df.withColumn("s", F.coalesce(F.sum("w").over(own), F.lit(0)).cast("long"))
            found = running_sum(df, by, order, "w", "s")
            assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))


def test_groups_of_numbers_without_value_are_summed(spark):
    values = [None, float("nan"), -0.0, 0.0, 1.5]
    df = spark.createDataFrame([(values[i % 5], "ab"[i % 2], i) for i in range(400)], "x double, g string, i long")
    for by in (["x"], ["x", "g"]):
        expected = df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("i")) - 1)
        found = running_sum(df, by, ["i"]).select("i", "position")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.select("i", "n").collect()))


def test_sums_of_many_ranges_are_looked_up_by_a_join(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        df = spark.range(0, 20000, 1, 40).select(
            F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("g"),
            F.col("id").alias("i"),
        )
        own = Window.partitionBy("g").orderBy("i")
        expected = df.withColumn("n", F.row_number().over(own) - 1)
        found = running_sum(df, ["g"], ["i"])
        wrong = found.join(expected, "i").filter("position <> n")
        assert (found.count(), wrong.count()) == (20000, 0)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # Neither a map nor a list is searched for every row.
        assert "try_element_at" not in plan and "array_contains" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_hot_group_is_summed_in_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 9000, 1, 4).select(F.lit("hot").alias("g"), F.col("id").alias("i"))
        placed = running_sum(df, ["g"], ["i"]).withColumn("part", F.spark_partition_id()).collect()
        assert all(r.position == r.i for r in placed)
        assert len({r.part for r in placed}) > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
