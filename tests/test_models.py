"""Fits, scoring and monitoring with real models."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelgate.operators import metrics, models
from panelgate.operators.joins import spread_join
from panelgate.operators.versions import register
from panelgate.plans import monitor
from panelgate.schemas import MODEL_VERSIONS

SMALL = {"maxIter": 3, "maxDepth": 3}


@pytest.fixture(scope="module")
def table(spark):
    n = F.col("id")
    return spark.range(0, 600, 1, 4).select(
        (n % 50).cast("double").alias("Daily_ICU_occupancy"),
        (n % 7).cast("double").alias("Daily_hospital_occupancy"),
        (n % 4 + 1).cast("int").alias("quarter"),
        ((n % 50) * 3 + n % 7).cast("double").alias("y"),
    )


@pytest.fixture(scope="module")
def model(table):
    return models.fit_regressor(table, **SMALL)


def test_fit_beats_the_mean_and_repeats(table, model):
    scored = models.predict(table, model)
    assert scored.columns == table.columns + ["y_hat"]
    error = metrics.mse(scored).collect()[0].mse
    assert error < table.agg(F.var_pop("y")).collect()[0][0]
    again = models.fit_regressor(table, **SMALL)
    assert metrics.mse(models.predict(table, again)).collect()[0].mse == error


def test_fit_deals_out_partitions_of_too_many_rows(table, monkeypatch):
    seen = []
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, rows: seen.append(rows))
    whole = table.coalesce(1)
    models.fit_regressor(whole, **SMALL)
    monkeypatch.setattr(models, "FIT_TASK_BYTES", 100 * (models.FIT_ROW_BYTES + 3 * models.FIT_FEATURE_BYTES))
    models.fit_regressor(whole, **SMALL)
    sizes = [[len(p) for p in rows.rdd.glom().collect()] for rows in seen]
    assert sizes[0] == [600]
    assert sum(sizes[1]) == 600 and max(sizes[1]) <= 110
    assert sorted(seen[1].collect()) == sorted(seen[0].collect())


def test_defaults_of_the_learner():
    assert (models.ROUNDS, models.DEPTH, models.RATE, models.ROW_SHARE) == (1000, 8, 0.1, 1.0)


def test_contract(table):
    contract = models.infer_contract(table.drop("y"))
    assert models.check_contract(table, contract).columns == table.drop("y").columns
    with pytest.raises(ValueError, match="quarter: expected int, found nothing"):
        models.check_contract(table.drop("quarter"), contract)
    with pytest.raises(ValueError, match="quarter: expected int, found string"):
        models.check_contract(table.withColumn("quarter", F.lit("1")), contract)


class Sum:
    def predict(self, frame):
        return frame.sum(axis=1)


def test_python_model_sees_features_in_order(table):
    class Columns:
        def predict(self, frame):
            assert list(frame.columns) == [
                "Daily_ICU_occupancy", "Daily_hospital_occupancy", "quarter",
            ]
            return frame["Daily_ICU_occupancy"]

    scored = models.predict_python(table, Columns())
    assert scored.filter("y_hat != Daily_ICU_occupancy").isEmpty()


def test_python_model_that_is_too_large(table, monkeypatch):
    monkeypatch.setattr(models, "LARGEST_BROADCAST_MODEL", 10)
    features = ["Daily_ICU_occupancy", "Daily_hospital_occupancy"]

    class Added:
        def predict(self, frame):
            return frame.sum(axis=1)

    scored = models.predict_python(table, Added(), features).collect()
    assert all(r.y_hat == sum(r[f] for f in features) for r in scored)


def test_monitoring_of_stored_models(spark, table, model, tmp_path):
    root = str(tmp_path)
    runs = spark.createDataFrame([("m", "r1")], "name string, run_id string")
    versions = register(spark.createDataFrame([], MODEL_VERSIONS), runs)
    versions = versions.unionByName(register(versions, runs))
    versions = versions.withColumn("stage", F.lit("Production"))
    worse = models.fit_regressor(table, maxIter=1, maxDepth=1)
    models.save_version(model, root, "m", "1")
    models.save_version(worse, root, "m", "2")
    loaded = {
        ("m", "2"): models.load_version(versions, root, "m", stage="Production"),
        ("m", "1"): models.load_version(versions, root, "m", version="1"),
    }
    with pytest.raises(ValueError):
        models.load_version(versions, root, "m")
    examples = table.withColumn("name", F.lit("m"))
    result = monitor(versions, examples, models.score_pairs(loaded)).collect()
    assert [(r.name, r.version, r.previous_version, r.outcome) for r in result] == [
        ("m", "2", "1", "worse")
    ]
    with pytest.raises(KeyError):
        monitor(versions, examples, models.score_pairs({("m", "2"): model}))


def test_scorer_without_any_pair(spark, table, model):
    versions = spark.createDataFrame([("m", "1", "Production", "", "r")], MODEL_VERSIONS)
    examples = table.withColumn("name", F.lit("m"))
    rows = monitor(versions, examples, models.score_pairs({("m", "1"): model})).collect()
    assert [(r.name, r.version, r.outcome) for r in rows] == [("m", "1", "too few versions")]


def test_every_model_is_in_the_report(spark, table):
    rows = [(n, str(v), s, "", f"{n}{v}") for n, v, s in (
        ("a", 1, "Production"), ("a", 2, "Production"), ("gap", 5, "Production"), ("none", 1, "Staging"),
        ("zero", 0, "Production"), ("unseen", 1, "Archived"), ("unseen", 2, "Production"))]
    versions = spark.createDataFrame(rows, MODEL_VERSIONS)
    examples = table.withColumn("name", F.lit("a"))

    def score(rows):
        return rows.withColumn("y_hat1", F.col("y") + 1).withColumn("y_hat2", F.col("y") + 1)

    assert {r.name: (r.version, r.outcome) for r in monitor(versions, examples, score).collect()} == {
        "a": ("2", "similar"), "gap": ("5", "no previous version"), "none": ("-1000", "too few versions"),
        "zero": ("0", "too few versions"), "unseen": ("2", "no examples"),
    }


def test_each_model_is_loaded_about_once_per_partition(spark, table, tmp_path):
    folder = str(tmp_path)

    class Added:
        def predict(self, frame):
            return frame.sum(axis=1)

    def load(name, version):
        import tempfile

        tempfile.NamedTemporaryFile(dir=folder, prefix=f"{name}-", delete=False).close()
        return Added()

    rows = table.withColumn("name", F.concat(F.lit("m"), (F.col("y") % 30).cast("int").cast("string")))
    rows = rows.withColumn("version", F.lit("1"))
    features = ["Daily_ICU_occupancy", "Daily_hospital_occupancy"]
    scored = models.predict_many(rows, load, features).collect()
    assert len(scored) == 600
    assert all(r.y_hat == sum(r[f] for f in features) for r in scored)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(list(tmp_path.iterdir())) <= 30 + partitions
    with pytest.raises(PySparkException, match="no version"):
        models.predict_many(rows.withColumn("version", F.lit(None).cast("string")), load, features).collect()


def test_monitoring_refuses_missing_labels(spark, table):
    rows = [("m", str(v), "Production", "", f"r{v}") for v in (1, 2)]
    versions = spark.createDataFrame(rows, MODEL_VERSIONS)
    examples = table.withColumn("name", F.lit("m")).withColumn("y", F.lit(None).cast("double"))

    def score(rows):
        return rows.withColumns({"y_hat1": F.lit(1.0), "y_hat2": F.lit(2.0)})

    with pytest.raises(PySparkException):
        monitor(versions, examples, score).collect()


def test_hot_key_is_joined_in_many_tasks(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(0, 20_000, 1, 64).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
        .alias("name"), "id",
    ).write.parquet(path)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "2048",
        "spark.sql.files.openCostInBytes": "0",
        "spark.sql.shuffle.partitions": "16",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.read.parquet(path)
        lookup = rows.groupBy("name").agg(F.count("*").alias("n"))
        joined = spread_join(rows, lookup, ["name"])
        plain = rows.join(lookup, "name")
        assert sorted(joined.select(*plain.columns).collect()) == sorted(plain.collect())
        hot = joined.filter("name = 'hot'").groupBy(F.spark_partition_id().alias("p")).count()
        shares = [r["count"] for r in hot.collect()]
        assert len(shares) > 4
        assert max(shares) < 0.5 * sum(shares)
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_of_a_long_lookup_only_hot_keys_are_repeated(spark, tmp_path):
    path = str(tmp_path / "lookup")
    names = spark.range(40_000).select(F.concat(F.lit("k"), F.col("id")).alias("name"), "id")
    hot = spark.range(1).select(F.lit("hot").alias("name"), F.lit(-1).cast("bigint").alias("id"))
    names.unionByName(hot).write.parquet(path)
    rows = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), "id"))
        .alias("name"), F.col("id").alias("row"),
    )
    lookup = spark.read.parquet(path)
    joined = spread_join(rows, lookup, ["name"])
    # Repeated whole and broadcast: Spark sees only the size that it has on disk.
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    plain = rows.join(lookup, "name")
    assert joined.columns == plain.columns
    assert sorted(joined.collect()) == sorted(plain.collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        at = joined.filter("name = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert at > 1


def test_stored_models_are_monitored_over_a_long_lookup(spark, monkeypatch):
    from panelgate.operators import joins

    monkeypatch.setattr(joins, "FEW_REPEATED", 8)
    names = [("hot", 1), ("hot", 2)] + [(f"m{i}", v) for i in range(30) for v in (1, 2)]
    versions = spark.createDataFrame([(n, str(v), "Production", "", n) for n, v in names], MODEL_VERSIONS)
    rows = spark.range(0, 900, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("m"), F.col("id") % 30))
        .alias("name"), F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"),
    )

    class Added:
        def __init__(self, n):
            self.n = n

        def predict(self, frame):
            return frame["x"] + self.n

    scored = []

    def score(joined):
        scored.append(joined._jdf.queryExecution().executedPlan().toString())
        return models.score_stored(lambda name, version: Added(int(version)), ["x"])(joined)

    found = monitor(versions, rows, score).collect()
    assert "SortMergeJoin" in scored[0]
    seen = {r["name"] for r in rows.dropna().collect()}
    assert len(found) == 31 and len(seen) == 21
    for r in found:
        expected = (4.0, 1.0, "worse") if r.name in seen else (None, None, "no examples")
        assert (r.mse1, r.mse2, r.outcome) == expected


def test_a_hot_model_is_scored_in_equal_parts_and_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        made.add(1)
        return i

    rows = spark.range(0, 4000, 1, 5).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 40)).alias("name"),
        F.lit("1").alias("version"), counted("id").cast("double").alias("x"),
    )
    folder = str(tmp_path)

    class Twice:
        def predict(self, frame):
            return frame["x"] * 2

    def load(name, version):
        import tempfile

        tempfile.NamedTemporaryFile(dir=folder, prefix=f"{name}-", delete=False).close()
        return Twice()

    scored = models.predict_many(rows, load, ["x"]).withColumn("part", F.spark_partition_id())
    found = scored.collect()
    assert len(found) == 4000 and all(r.y_hat == 2 * r.x for r in found)
    assert made.value == 4000
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    loads = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert len(loads) <= 41 + partitions
    assert 2 <= loads.count("hot") <= 4
