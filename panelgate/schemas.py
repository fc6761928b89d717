"""Table layouts shared by sources, sinks and plans."""

from pyspark.sql import types as T


def _strings(*names):
    return [T.StructField(n, T.StringType(), True) for n in names]


INDICATORS = T.StructType(_strings("entity", "iso_code", "date", "indicator", "value"))

MODEL_VERSIONS = T.StructType(
    _strings("name", "version", "stage", "description", "run_id")
)

RUNS = T.StructType(
    _strings("run_id", "run_name")
    + [T.StructField("start_time", T.TimestampType(), True)]
)

RUN_VALUES = T.StructType(
    _strings("run_id", "kind", "key")
    + [T.StructField("value", T.DoubleType(), True)]
)


def _ledger(action):
    return T.StructType(
        _strings(
            "from_workspace",
            f"{action}_model_name",
            f"{action}_model_version",
            "external_location",
        )
        + [T.StructField("timestamp", T.TimestampType(), True)]
    )


EXPORT_LEDGER = _ledger("exported")
IMPORT_LEDGER = _ledger("imported")
