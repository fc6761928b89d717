"""Fitting, scoring and loading of regressors on tables."""

import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgate.columns import named, require_columns, required
from panelgate.operators.features import FEATURES
from panelgate.operators.versions import newest_version_of
from panelgate.storage import scratch_table, shared_dir

# Rounds, depth, learning rate and row share of the boosted trees.
ROUNDS, DEPTH, RATE, ROW_SHARE, SEED = 1000, 8, 0.1, 1.0, 0

# A fit keeps some bytes of every row and, beyond them, some of every feature; a task's rows
# should take no more than its share.
FIT_ROW_BYTES, FIT_FEATURE_BYTES, FIT_TASK_BYTES = 240, 8, 256 * 1024 * 1024

# A model is broadcast whole, so its size is checked first.
LARGEST_BROADCAST_MODEL = 512 * 1024 * 1024


def fit_regressor(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = "y",
    **params,
) -> PipelineModel:
    """Boosted regression trees; ``params`` override those of the tree learner.

    Every tree adds to the lineage of the residuals. It is cut by checkpoints in
    the shared folder every ten rounds. Every task keeps its rows and reads them in each
    round, so partitions of too many rows are dealt out first.
    """
    shared_dir(df.sparkSession)
    trees = GBTRegressor(
        featuresCol="_features",
        labelCol=label,
        predictionCol="y_hat",
        maxIter=ROUNDS,
        maxDepth=DEPTH,
        stepSize=RATE,
        subsamplingRate=ROW_SHARE,
        seed=SEED,
        checkpointInterval=10,
    ).setParams(**params)
    assembler = VectorAssembler(inputCols=sorted(features), outputCol="_features")
    rows = df.select(*[named(f) for f in sorted(features)], named(label))
    most = FIT_TASK_BYTES // (FIT_ROW_BYTES + FIT_FEATURE_BYTES * len(features))
    return Pipeline(stages=[assembler, trees]).fit(_in_parts(rows, most))


def _in_parts(rows, most):
    """``rows`` in partitions of about ``most`` rows at most, as they are where none has more.

    Dealt rows are sorted in their partition: a part that is made again has the same order,
    by which the learner samples and pairs its rows.
    """
    counted = rows.groupBy(F.spark_partition_id().alias("_part")).count()
    largest, total, parts = counted.agg(F.max("count"), F.sum("count"), F.count("*")).head()
    if (largest or 0) <= most:
        return rows
    dealt = rows.repartition(max(parts, -(-total // most)))
    return dealt.sortWithinPartitions(*[named(c) for c in rows.columns])


def predict(df: DataFrame, model: Model, name: str = "y_hat") -> DataFrame:
    """Input columns plus the predictions of a Spark ML model."""
    scored = model.transform(df)
    return scored.select(*[named(c) for c in df.columns], F.col("y_hat").alias(name))


def predict_python(
    df: DataFrame, model, features: Sequence[str] = FEATURES, name: str = "y_hat"
) -> DataFrame:
    """Predictions of any object with ``predict(pandas frame)``, in Arrow batches.

    Only the features go to Python. The model is shipped once per executor.
    """
    require_columns(df, *features)
    packed = cloudpickle.dumps(model)
    spark = df.sparkSession
    if len(packed) > LARGEST_BROADCAST_MODEL:
        return _predict_large(df, packed, features, name)
    shipped = spark.sparkContext.broadcast(packed)

    @F.pandas_udf(T.DoubleType())
    def y_hat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        loaded = cloudpickle.loads(shipped.value)
        for batch in batches:
            yield pd.Series(loaded.predict(batch)).astype("float64")

    return df.withColumn(name, y_hat(F.struct(*[named(f) for f in sorted(features)])))


def _predict_large(df, packed, features, name):
    """As ``predict_python``; the model lies in the shared folder in pieces, in order."""
    spark, size = df.sparkSession, 64 * 1024 * 1024
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    pieces = [(i, bytearray(packed[at : at + size])) for i, at in enumerate(range(0, len(packed), size))]
    spark.createDataFrame(pieces, "i int, piece binary").write.parquet(path)

    @F.pandas_udf(T.DoubleType())
    def y_hat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        where = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        system, folder = fs.FileSystem.from_uri(where)
        table = ds.dataset(folder, filesystem=system).to_table().sort_by("i")
        loaded = cloudpickle.loads(b"".join(p.as_py() for p in table["piece"]))
        for batch in batches:
            yield pd.Series(loaded.predict(batch)).astype("float64")

    return df.withColumn(name, y_hat(F.struct(*[named(f) for f in sorted(features)])))


def predict_many(
    df: DataFrame,
    load: Callable[[str, str], object],
    features: Sequence[str] = FEATURES,
    version: str = "version",
    name: str = "y_hat",
) -> DataFrame:
    """Predictions of each row's own model, for any number of models in one job.

    ``load(name, version)`` runs in the tasks and reads a Python model from shared
    storage. Rows are dealt by model; a model with more rows than a partition's share is
    cut into equal shares, so there are at most as many loads as models and partitions
    together. Rows without name or version are an error.
    """
    return _by_model(df, load, features, {version: name})


def score_stored(
    load: Callable[[str, str], object], features: Sequence[str] = FEATURES
) -> Callable[[DataFrame], DataFrame]:
    """Scorer for ``monitor`` over stored Python models, any number of them.

    Rows move once: both versions of a pair score them in the same pass.
    """
    names = {"version": "y_hat1", "previous_version": "y_hat2"}
    return lambda rows: _by_model(rows, load, features, names)


def _by_model(df, load, features, names):
    require_columns(df, "name", *names, *features)
    keys = ["name", *names]
    for key in keys:
        df = df.withColumn(key, required(named(key), f"a row to score has no {key}"))
    inputs = [named(f) for f in sorted(features)]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def y_hats(
        batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]],
    ) -> Iterator[pd.Series]:
        current, loaded = None, []
        for of, batch in batches:
            columns = [of[c].to_numpy() for c in of.columns]
            out = np.zeros((len(batch), len(columns) - 1))
            changed = np.zeros(len(batch), bool)
            for column in columns:
                changed[1:] |= column[1:] != column[:-1]
            starts = [0, *np.flatnonzero(changed), len(batch)] if len(batch) else []
            for start, end in zip(starts, starts[1:]):
                key = tuple(column[start] for column in columns)
                if key != current:
                    current, loaded = key, [load(key[0], v) for v in key[1:]]
                rows = batch.iloc[start:end]
                for i, model in enumerate(loaded):
                    out[start:end, i] = model.predict(rows)
            yield pd.Series(list(out), index=batch.index)

    scores = y_hats(F.struct(*[named(k) for k in keys]), F.struct(*inputs))
    scored = _dealt_by_model(df, keys).withColumn("_y_hats", scores)
    for i, column in enumerate(names.values()):
        scored = scored.withColumn(column, F.get("_y_hats", F.lit(i)))
    return scored.drop("_y_hats")


def _dealt_by_model(df, keys):
    """Rows by model, those with more than a partition's share of rows in equal parts.

    The rows are written down once, so what leads to them is evaluated once and a part's
    rows are the same ones when a task runs again. Fewer models than partitions can have
    more than a share: their list is broadcast.
    """
    written = scratch_table(df, "scoring")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = written.count()
    counted = written.groupBy(*[named(k) for k in keys]).count()
    hot = counted.filter(F.col("count") * partitions > total).select(
        *[named(k) for k in keys],
        F.ceil(F.col("count") * partitions / F.lit(max(total, 1))).alias("_parts"),
    )
    row = F.monotonically_increasing_id()
    placed = written.withColumn("_row", row).join(F.broadcast(hot), keys, "left").withColumn(
        "_part", F.coalesce(F.pmod("_row", "_parts"), F.lit(0))
    )
    by = [named(k) for k in keys]
    dealt = placed.repartition(partitions, *by, "_part").sortWithinPartitions(*by)
    return dealt.select(*[named(c) for c in df.columns])


def score_pairs(models: Mapping[tuple[str, str], Model]) -> Callable[[DataFrame], DataFrame]:
    """Scorer for ``monitor`` out of loaded Spark ML models, keyed by (name, version).

    Each pair is one transform over its own rows, so this suits a handful of
    models; ``score_stored`` takes any number.
    """

    def score(rows: DataFrame) -> DataFrame:
        pairs = rows.select("name", "version", "previous_version").distinct()
        parts = []
        for name, current, previous in pairs.limit(len(models) + 1).collect():
            own = rows.filter(F.col("name") == name)
            both = predict(own, models[name, current], "y_hat1")
            parts.append(predict(both, models[name, previous], "y_hat2"))
        if not parts:
            missing = F.lit(None).cast("double")
            return rows.withColumn("y_hat1", missing).withColumn("y_hat2", missing)
        scored = parts[0]
        for part in parts[1:]:
            scored = scored.unionByName(part)
        return scored

    return score


def model_path(root: str, name: str, version: str) -> str:
    return f"{root}/{name}/{version}"


def save_version(model: PipelineModel, root: str, name: str, version: str) -> str:
    path = model_path(root, name, version)
    model.write().overwrite().save(path)
    return path


def load_version(
    versions: DataFrame,
    root: str,
    name: str,
    version: str | None = None,
    stage: str | None = None,
) -> PipelineModel:
    """Stored model by number, or the newest one of a stage."""
    if (version is None) == (stage is None):
        raise ValueError("give a version or a stage")
    if version is None:
        version = newest_version_of(versions, name, stage)
    return PipelineModel.load(model_path(root, name, version))


def infer_contract(df: DataFrame) -> str:
    """Column names and types as JSON, to be stored beside a model."""
    return df.schema.json()


def contract_problems(df: DataFrame, contract: str) -> list[str]:
    """Columns of the contract that ``df`` lacks or has in another type."""
    wanted = T.StructType.fromJson(json.loads(contract))
    found = {f.name: f.dataType for f in df.schema.fields}
    return [
        f"{f.name}: expected {f.dataType.simpleString()}, found "
        + (found[f.name].simpleString() if f.name in found else "nothing")
        for f in wanted.fields
        if found.get(f.name) != f.dataType
    ]


def check_contract(df: DataFrame, contract: str) -> DataFrame:
    """``df`` in the contract's columns; missing ones or other types are an error."""
    problems = contract_problems(df, contract)
    if problems:
        raise ValueError("; ".join(problems))
    wanted = T.StructType.fromJson(json.loads(contract))
    return df.select(*[named(f.name) for f in wanted.fields])


def contract_path(root: str, name: str, version: str) -> str:
    return f"{root}/contracts/{name}/{version}"


def save_contract(df: DataFrame, root: str, name: str, version: str) -> str:
    """Store the contract of a model's inputs beside the model."""
    path = contract_path(root, name, version)
    text = df.sparkSession.createDataFrame([(infer_contract(df),)], "contract string")
    text.coalesce(1).write.mode("overwrite").text(path)
    return path


def load_contract(spark: SparkSession, root: str, name: str, version: str) -> str:
    return spark.read.text(contract_path(root, name, version), wholetext=True).head()[0].strip()
