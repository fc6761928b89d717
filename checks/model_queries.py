"""Models fitted and applied on whole tables."""

import uuid

from pyspark.sql import functions as F

from checks import shapes
from checks.registry import query
from panelgate.operators import features as ft
from panelgate.operators import metrics, models
from panelgate.operators.versions import register

_FEATURES = ["l_discount", "l_quantity", "l_tax"]
_FEW_ROUNDS = {"maxIter": 3, "maxDepth": 3}


def _lines(spark, sf_dir):
    return shapes.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *_FEATURES, F.col("l_extendedprice").alias("y")
    )


@query("""
    SELECT count(*) AS n_rows, round(var_pop(l_extendedprice), 1) AS mse_of_mean,
           true AS better_than_mean
    FROM lineitem""")
def ml1_fit_regressor(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    model = models.fit_regressor(lines, _FEATURES, **_FEW_ROUNDS)
    fitted = metrics.mse(models.predict(lines, model)).scalar()
    return lines.agg(
        F.count("*").alias("n_rows"),
        F.round(F.var_pop("y"), 1).alias("mse_of_mean"),
        (F.var_pop("y") > fitted).alias("better_than_mean"),
    )


@query("""
    SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_different,
           true AS better_than_mean
    FROM lineitem""")
def ml2_predict(spark, sf_dir):
    """Rows, nulls, differences after the model is stored and read again, and the error."""
    lines = _lines(spark, sf_dir)
    model = models.fit_regressor(lines, _FEATURES, **_FEW_ROUNDS)
    path = models.save_version(model, shapes.scratch(spark), "m", "1")
    loaded = models.load_version(None, path.rsplit("/", 2)[0], "m", "1")
    scored = models.predict(ft.drop_label(lines), model, "y_hat1")
    both = models.predict(scored, loaded, "y_hat2")
    error = metrics.mse(models.predict(lines, model)).scalar()
    variance = lines.agg(F.var_pop("y")).scalar()
    return both.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("y_hat1").isNull()).alias("n_null"),
        F.count_if(F.col("y_hat1") != F.col("y_hat2")).alias("n_different"),
    ).withColumn("better_than_mean", error < variance)


@query("""
    SELECT l_orderkey, l_linenumber, l_discount, l_quantity, l_tax,
           l_quantity * 1000.0 + l_tax * 8.0 AS y_hat
    FROM lineitem""")
def ml2_predict_python(spark, sf_dir):
    class Weighted:
        def predict(self, frame):
            return frame["l_quantity"] * 1000.0 + frame["l_tax"] * 8.0

    inputs = ft.drop_label(_lines(spark, sf_dir))
    return models.predict_python(inputs, Weighted(), _FEATURES)


@query("""
    SELECT l_orderkey, l_linenumber, l_returnflag AS name,
           CAST(l_linenumber AS VARCHAR) AS version, l_discount, l_quantity, l_tax,
           l_quantity * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE 4.0 END
             * l_linenumber AS y_hat
    FROM lineitem""")
def ml2_predict_many(spark, sf_dir):
    factors = {"A": 1.0, "N": 2.0, "R": 4.0}

    class Scaled:
        def __init__(self, factor):
            self.factor = factor

        def predict(self, frame):
            return frame["l_quantity"] * self.factor

    def load(name, version):
        return Scaled(factors[name] * int(version))

    lines = shapes.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_returnflag").alias("name"),
        F.col("l_linenumber").cast("string").alias("version"),
        *_FEATURES,
    )
    return models.predict_many(lines, load, _FEATURES)


@query("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM lineitem")
def ml3_load_version(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    model = models.fit_regressor(lines, _FEATURES, **_FEW_ROUNDS)
    name, root = f"m{uuid.uuid4().hex}", shapes.scratch(spark)
    run = spark.createDataFrame([(name, "r1")], "name string, run_id string")
    versions = shapes.versions(spark, sf_dir)
    versions = versions.unionByName(register(versions, run))
    models.save_version(model, root, name, "1")
    loaded = models.load_version(versions, root, name, stage="None")
    both = models.predict(models.predict(lines, model, "y_hat1"), loaded, "y_hat2")
    return both.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("y_hat1") != F.col("y_hat2")).alias("n_different"),
    )


@query("SELECT l_discount, l_quantity, l_tax FROM lineitem")
def ml4_check_contract(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    contract = models.infer_contract(lines.select(*_FEATURES))
    return models.check_contract(lines, contract)


@query("""
    SELECT problem, n_rows FROM (SELECT count(*) AS n_rows FROM lineitem),
      (SELECT unnest(['l_discount: expected double, found string',
                      'l_tax: expected double, found nothing']) AS problem)""")
def ml4_contract_problems(spark, sf_dir):
    """A row per column that does not fit the contract."""
    lines = _lines(spark, sf_dir)
    contract = models.infer_contract(lines.select(*_FEATURES))
    other = lines.withColumn("l_discount", F.col("l_discount").cast("string")).drop("l_tax")
    problems = models.contract_problems(other, contract)
    counted = other.agg(F.count("*").alias("n_rows"))
    found = F.array(*[F.lit(p) for p in problems])
    return counted.select(F.explode(found).alias("problem"), "n_rows")
