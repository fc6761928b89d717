"""Shared folders and directory listings through the cluster's own file system."""

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, used for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting falls back to a temporary folder.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="panelgate-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def _file_system(spark, path):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop_path = _file_system(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in fs.listStatus(hadoop_path)]


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is evaluated once.

    The folder is deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/panelgate-{name}-{uuid.uuid4().hex}"
    fs, hadoop_path = _file_system(spark, path)
    fs.deleteOnExit(hadoop_path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)


def age_seconds(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was changed, by the clock of this machine."""
    fs, hadoop_path = _file_system(spark, path)
    now = spark._jvm.java.lang.System.currentTimeMillis()
    return (now - fs.getFileStatus(hadoop_path).getModificationTime()) / 1000


def create_json(spark: SparkSession, path: str, value: dict) -> bool:
    """Make a small file unless there is one of this name; whether this call made it.

    The file is written under another name and renamed without overwriting, so others
    see it whole or not at all, and of two writers one is told that it came too late.
    """
    fs, target = _file_system(spark, path)
    jvm, hadoop = spark._jvm, spark._jvm.org.apache.hadoop.fs
    draft = hadoop.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), none)
    except Py4JJavaError as problem:
        fs.delete(draft, False)
        if "FileAlreadyExists" in problem.java_exception.getClass().getName():
            return False
        raise
    return True


def read_json(spark: SparkSession, path: str) -> dict:
    fs, hadoop_path = _file_system(spark, path)
    source = fs.open(hadoop_path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    return json.loads(text)
