"""Inputs of the operators, derived from the test tables by projection alone.

Each shape is defined twice, as a DataFrame and as a SQL subquery. Models and
countries are skewed on purpose: one key holds a third of all rows. Indicator
values are roots, so that rounded means never lie halfway between two numbers.
"""

import uuid

from pyspark.sql import functions as F

from panelgate.storage import shared_dir

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LONG_FEATURES, LONG_LABEL = ["1-URGENT", "2-HIGH", "quarter"], "5-LOW"


_SCHEMAS = {}


def table(spark, sf_dir, name):
    """Test table; the job that looks its schema up runs once per file."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def scratch(spark):
    """New folder for the files one call of a query writes."""
    return f"{shared_dir(spark)}/panelgate-{uuid.uuid4().hex}"


def scratch_database(spark):
    name = f"panelgate_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch(spark)}'")
    return name


# Indicators per month, two countries.

def long(spark, sf_dir):
    usa = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        F.when(usa, "United States").otherwise("Algeria").alias("entity"),
        F.when(usa, "USA").otherwise("DZA").alias("iso_code"),
        F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("date"),
        F.col("o_orderpriority").alias("indicator"),
        F.when(F.col("o_orderkey") % 7 != 0, F.sqrt("o_totalprice")).alias("value"),
    )


LONG = """
(SELECT CASE WHEN o_orderstatus = 'F' THEN 'United States' ELSE 'Algeria' END AS entity,
        CASE WHEN o_orderstatus = 'F' THEN 'USA' ELSE 'DZA' END AS iso_code,
        strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS "date",
        o_orderpriority AS indicator,
        CASE WHEN o_orderkey % 7 <> 0 THEN sqrt(o_totalprice) END AS value
 FROM orders)"""


# Indicators per month, four countries: FRA never reports an indicator that is not
# selected, ITA never reports the label; their orders count as other indicators.

def long_countries(spark, sf_dir):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    italy = (status == "O") & (F.col("o_custkey") % 5 == 0)
    return table(spark, sf_dir, "orders").select(
        F.when(status == "F", "USA").when(italy, "ITA").when(status == "O", "DZA")
        .otherwise("FRA").alias("iso_code"),
        F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("date"),
        F.when((status == "P") & (priority == "4-NOT SPECIFIED"), "1-URGENT")
        .when(italy & (priority == LONG_LABEL), "2-HIGH").otherwise(priority).alias("indicator"),
        F.when(F.col("o_orderkey") % 7 != 0, F.sqrt("o_totalprice")).alias("value"),
    )


LONG_COUNTRIES = """
(SELECT CASE WHEN o_orderstatus = 'F' THEN 'USA'
             WHEN o_orderstatus = 'O' AND o_custkey % 5 = 0 THEN 'ITA'
             WHEN o_orderstatus = 'O' THEN 'DZA' ELSE 'FRA' END AS iso_code,
        strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS "date",
        CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN '1-URGENT'
             WHEN o_orderstatus = 'O' AND o_custkey % 5 = 0 AND o_orderpriority = '5-LOW'
               THEN '2-HIGH'
             ELSE o_orderpriority END AS indicator,
        CASE WHEN o_orderkey % 7 <> 0 THEN sqrt(o_totalprice) END AS value
 FROM orders)"""


# Indicators per day, with one country that holds a third of the rows and more.

def long_daily(spark, sf_dir):
    user = F.col("user_id")
    code = F.when(F.col("event_id") % 3 == 0, 0).otherwise(user % 5)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("C"), code.cast("string")).alias("iso_code"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.col("event_type").alias("indicator"),
        F.sqrt("value").alias("value"),
    )


LONG_DAILY = """
(SELECT 'C' || CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 5 END AS VARCHAR) AS iso_code,
        strftime(ts, '%Y-%m-%d') AS "date", event_type AS indicator, sqrt(value) AS value
 FROM events)"""


# One wide row per order, with nulls.

def wide(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("row id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(key % 5 != 0, F.col("o_totalprice")).alias("Daily ICU occupancy"),
        F.when(key % 7 != 0, F.col("o_custkey").cast("double")).alias("Daily hospital occupancy"),
        (key % 11).cast("double").alias("Weekly new hospital admissions"),
        F.when(key % 13 != 0, F.col("o_orderpriority")).alias("remark"),
    )


WIDE = """
(SELECT o_orderkey AS "row id", strftime(o_orderdate, '%Y-%m-%d') AS "date",
        CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS "Daily ICU occupancy",
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS "Daily hospital occupancy",
        CAST(o_orderkey % 11 AS DOUBLE) AS "Weekly new hospital admissions",
        CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS remark
 FROM orders)"""


# Model versions: model "hot" has a third of them all, without gaps; the others
# have up to 16 each, with a gap after every second number.

def _model():
    return F.when(F.col("o_orderkey") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("m"), F.expr("o_orderkey div 24").cast("string"))
    )


_MODEL = "CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE 'm' || CAST(o_orderkey // 24 AS VARCHAR) END"


# Some models have no Production version, some only version 0 or 1, and some keep
# their numbers with zeros in front.

def versions(spark, sf_dir):
    key, block = F.col("o_orderkey"), F.expr("o_orderkey div 24")
    hot, single = key % 3 == 0, block % 11 == 4
    number = F.when(hot, F.expr("o_orderkey div 3") + 1).when(single, key % 2).otherwise(key % 24 + 1)
    text = number.cast("string")
    status = F.col("o_orderstatus")
    produced = F.when(~hot & (block % 7 == 3), "Archived").otherwise("Production")
    exported = F.concat(F.lit("Already Exported "), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(
        F.when(~hot & single, F.concat(_model(), F.lit("_"), key.cast("string")))
        .otherwise(_model()).alias("name"),
        F.when(~hot & (block % 13 == 6), F.concat(F.lit("00"), text)).otherwise(text).alias("version"),
        F.when(status == "O", "None").when(status == "F", "Staging")
        .otherwise(produced).alias("stage"),
        F.when(key % 5 == 0, exported)
        .when(key % 11 != 0, F.col("o_orderpriority")).alias("description"),
        F.concat(F.lit("r"), key.cast("string")).alias("run_id"),
    )


_BLOCK = "o_orderkey // 24"
_NUMBER = f"""CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 3 + 1
                        WHEN {_BLOCK} % 11 = 4 THEN o_orderkey % 2 ELSE o_orderkey % 24 + 1 END
                   AS VARCHAR)"""
VERSIONS = f"""
(SELECT CASE WHEN o_orderkey % 3 <> 0 AND {_BLOCK} % 11 = 4
             THEN {_MODEL} || '_' || CAST(o_orderkey AS VARCHAR) ELSE {_MODEL} END AS name,
        CASE WHEN o_orderkey % 3 <> 0 AND {_BLOCK} % 13 = 6 THEN '00' ELSE '' END || {_NUMBER}
          AS version,
        CASE WHEN o_orderstatus = 'O' THEN 'None' WHEN o_orderstatus = 'F' THEN 'Staging'
             WHEN o_orderkey % 3 <> 0 AND {_BLOCK} % 7 = 3 THEN 'Archived' ELSE 'Production' END
          AS stage,
        CASE WHEN o_orderkey % 5 = 0 THEN 'Already Exported ' || o_orderpriority
             WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS description,
        'r' || CAST(o_orderkey AS VARCHAR) AS run_id
 FROM orders)"""


# Export ledger: one row per order, several of one moment.

def ledger(spark, sf_dir):
    name = F.concat(F.lit("m"), (F.col("o_orderkey") % 1000).cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("workspace_"), F.col("o_custkey").cast("string"), F.lit("_b"))
        .alias("from_workspace"),
        name.alias("exported_model_name"),
        F.col("o_orderkey").cast("string").alias("exported_model_version"),
        F.concat(F.lit("s3a://x/m/"), name, F.lit("/r"), F.col("o_orderkey").cast("string"))
        .alias("external_location"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


LEDGER = """
(SELECT 'workspace_' || CAST(o_custkey AS VARCHAR) || '_b' AS from_workspace,
        'm' || CAST(o_orderkey % 1000 AS VARCHAR) AS exported_model_name,
        CAST(o_orderkey AS VARCHAR) AS exported_model_version,
        's3a://x/m/m' || CAST(o_orderkey % 1000 AS VARCHAR) || '/r' || CAST(o_orderkey AS VARCHAR)
          AS external_location,
        o_orderdate AS "timestamp"
 FROM orders)"""


# Two predictions per line item; models A, N and R are close, worse and better.

def scored(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    quantity, price, flag = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_returnflag"))
    fitted = lines.agg(
        F.struct(
            F.regr_slope(price, quantity).alias("slope"),
            F.regr_intercept(price, quantity).alias("intercept"),
            F.avg(price).alias("mean"),
        )
    ).scalar()
    linear = fitted["slope"] * quantity + fitted["intercept"]
    return lines.select(
        flag.alias("name"),
        price.alias("y"),
        F.when(flag == "A", linear).when(flag == "N", 0.0).otherwise(fitted["mean"])
        .alias("y_hat1"),
        F.when(flag == "R", 0.0).otherwise(fitted["mean"]).alias("y_hat2"),
    )


SCORED = """
(SELECT l_returnflag AS name, l_extendedprice AS y,
        CASE l_returnflag WHEN 'A' THEN slope * l_quantity + intercept
                          WHEN 'N' THEN 0.0 ELSE mean END AS y_hat1,
        CASE l_returnflag WHEN 'R' THEN 0.0 ELSE mean END AS y_hat2
 FROM lineitem,
      (SELECT regr_slope(l_extendedprice, l_quantity) AS slope,
              regr_intercept(l_extendedprice, l_quantity) AS intercept,
              avg(l_extendedprice) AS mean FROM lineitem))"""


# One split JSON document of two rows per order, its columns not in name order.

EXAMPLE_COLUMNS = ["Daily_ICU_occupancy", "Daily_hospital_occupancy", "quarter", "y"]


def documents(spark, sf_dir):
    icu = F.col("o_totalprice") / 1000
    beds = F.col("o_custkey").cast("double")
    quarter = F.quarter("o_orderdate").cast("double")
    rows = F.array(
        F.array(icu + 1, quarter, beds, icu),
        F.array(icu * 2 - 1, quarter, beds + 1, icu * 2),
    )
    columns = F.array(
        *[F.lit(c) for c in ("y", "quarter", "Daily_hospital_occupancy", "Daily_ICU_occupancy")]
    )
    return table(spark, sf_dir, "orders").select(
        _model().alias("name"),
        F.to_json(F.struct(columns.alias("columns"), rows.alias("data"))).alias("document"),
    )


EXAMPLES = f"""
(SELECT {_MODEL} AS name, o_totalprice / 1000 AS "Daily_ICU_occupancy",
        CAST(o_custkey AS DOUBLE) AS "Daily_hospital_occupancy",
        CAST(quarter(o_orderdate) AS DOUBLE) AS quarter, o_totalprice / 1000 + 1 AS y
 FROM orders
 UNION ALL
 SELECT {_MODEL}, o_totalprice / 1000 * 2, CAST(o_custkey + 1 AS DOUBLE),
        CAST(quarter(o_orderdate) AS DOUBLE), o_totalprice / 1000 * 2 - 1
 FROM orders)"""
