"""From raw documents to packed training sequences in five stages.

``STAGES`` lists ``(name, function)``. Each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame; it is written as Parquet and read again as the next one's
documents, so a lost executor never costs more than the stage it worked on. All
stages but the last return the columns of the documents they were given.
"""

from pyspark.sql import DataFrame, SparkSession

from panelgate.llm import line_labels, mixing, packing, secrets, simhash
from panelgate.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    field = line_labels.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_labels.good_documents(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays, the one with the smallest id."""
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def sequence_packing(
    spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None
) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 tokens.

    ``tokenizer`` is the vocabulary's file, by default the packaged public one.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, tokenizer)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

#: No SQL: SQL can express neither the fitted field nor tokens; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
