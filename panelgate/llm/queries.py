"""One query per operator over its whole table, and the SQL for those SQL can express."""

from pyspark.sql import functions as F

from panelgate.llm import (
    capture_index,
    language_id,
    lexical_search,
    licences,
    line_labels,
    mixing,
    order_minhash,
    packing,
    repeats,
    secrets,
    simhash,
    site_style,
    whitening,
)

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query()
def op8_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = simhash.components(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query()
def op3_packing(spark, sf_dir):
    """Every document's pieces in sequences of 2048 tokens."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(documents(spark, sf_dir), path)


@query()
def op5_mixing(spark, sf_dir):
    """Per document what the mix takes of it."""
    found = mixing.mix(documents(spark, sf_dir))
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query()
def op4_line_labels(spark, sf_dir):
    """Base counts and verdict of every document."""
    docs = documents(spark, sf_dir)
    field = line_labels.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_labels.quality(docs, field)


@query()
def op9_secrets(spark, sf_dir):
    """Secrets of every document: base spans and what linking adds."""
    return secrets.scan(documents(spark, sf_dir))


@query()
def op6_warc(spark, sf_dir):
    """Every page as its archive record tells it."""
    return capture_index.archive(pages(spark, sf_dir))


@query()
def op10_order_minhash(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return order_minhash.edit_report(documents(spark, sf_dir))


@query()
def op7_repeats(spark, sf_dir):
    """Every document without strings of 100 bytes that an earlier place has."""
    return repeats.strip_repeats(documents(spark, sf_dir))


@query()
def op2_site_style(spark, sf_dir):
    """Main text of every page."""
    return site_style.main_texts(pages(spark, sf_dir))


@query()
def op1_licences(spark, sf_dir):
    """Licences of every document."""
    return licences.scan(documents(spark, sf_dir))


@query()
def op11_language_id(spark, sf_dir):
    """Language of every document, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    return language_id.predict(docs, language_id.train(docs))


@query()
def op12_whitening(spark, sf_dir):
    """Every embedding in whitened components."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query(lexical_search.SQL)
def op13_lexical_search(spark, sf_dir):
    """The best documents of every benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical_search.search(documents(spark, sf_dir), items)
