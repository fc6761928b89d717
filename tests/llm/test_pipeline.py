"""The pipeline's stages against brute force over the rows each one is given."""

import random

import pytest

import corpus_pipeline
from panelgate.llm import mixing, packing
from panelgate.llm.common import materialize
from tests.llm.conftest import DOC_SCHEMA, prose
from tests.llm.test_packing import check, sequences_are_gapless
from tests.llm.test_secrets import plain_base
from tests.llm.test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage was given and gave."""
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(60, 150))) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(120 + i, "###  $$$ ".join(prose(rng, 80).split())) for i in range(10)]
    rows += [(140 + i, rows[30 + i][1] + f"\ntoken = \"{rng.getrandbits(160):040x}\"") for i in range(5)]
    rows += [(150, None), (151, ""), (152, "few words")]
    full = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(full, DOC_SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 120 <= i < 130), 0) for i, _ in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    at = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [at]
    for name, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, folder), name)
        tables.append(at)
    return folder, tables


def test_columns_stay(stages):
    _, tables = stages
    for table in tables[1:-1]:
        assert table.dtypes == tables[0].dtypes


def test_quality_drops_junk_and_keeps_prose(stages):
    _, tables = stages
    kept = {r.doc_id for r in tables[1].collect()}
    assert not kept & {*range(120, 130), 150, 151, 152}
    assert kept >= set(range(80))


def test_one_document_of_each_group(stages):
    _, tables = stages
    rows = sorted((r.doc_id, r.text) for r in tables[1].collect())
    groups = plain_components([plain_fingerprint(t) for _, t in rows])
    assert {r.doc_id for r in tables[2].collect()} == {rows[g][0] for g in groups}


def test_no_secret_is_left(stages):
    _, tables = stages
    before = {r.doc_id: r.text for r in tables[2].collect()}
    after = {r.doc_id: r.text for r in tables[3].collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert not plain_base(after[i])
        assert bool(plain_base(text)) == (after[i] != text)


def test_mix_repeats_whole_rows(stages):
    _, tables = stages
    copies = {r.doc_id: r.copies for r in mixing.mix(tables[3]).collect()}
    counted = {}
    for r in tables[4].collect():
        counted[r.doc_id] = counted.get(r.doc_id, 0) + 1
    assert counted == {k: v for k, v in copies.items() if v}


def test_packing_holds_every_copy(stages):
    _, tables = stages
    rows = tables[5].collect()
    sequences_are_gapless(rows, packing.CAPACITY)
    texts = {r.doc_id: r.text for r in tables[4].collect()}
    assert sum(r.length for r in rows) == sum(
        next(p.doc_tokens for p in rows if p.doc_id == r.doc_id) for r in tables[4].collect()
    )
    once = {}
    for r in rows:
        once.setdefault((r.doc_id, r.start), r)
    check(list(once.values()), list(texts.items()))


def test_run_gives_the_last_stage(spark, stages):
    folder, tables = stages
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == tables[-1].columns
    assert rows.count() == tables[-1].count()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
