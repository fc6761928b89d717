"""Scratch tables, text columns and connected components for the operators here."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgate.storage import shared_dir

# A word is a run of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here.

    A lost executor then costs a re-read and not the work behind the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, ``text`` and further columns; a null text becomes the empty one."""
    return docs.select(
        F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *columns
    )


def _signature(edges):
    row = edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
    ).head()
    return tuple(row)


def star_components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table ``(a, b)`` of longs as ``(node, root)``.

    Large-star and small-star steps alternate until nothing changes, which takes
    about the logarithm of the longest path. Every node of an edge gets one row;
    the root is the component's smallest node. Minima are combined before their
    shuffle and joined back, so a node with very many links is one row per task
    there, and a skewed join partition can be split.
    """
    current = materialize(edges.filter("a <> b").distinct(), "edges")
    seen = _signature(current)
    while seen[0]:
        current = _small_star(_large_star(current))
        current = materialize(current, "edges")
        now = _signature(current)
        if now == seen:
            break
        seen = now
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("b", "b")
    )


def _large_star(edges):
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    # Each larger neighbour is tied to the smallest of the neighbourhood.
    return (
        both.filter("b > a").join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges):
    down = edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", "m")).filter("a <> b").distinct()
