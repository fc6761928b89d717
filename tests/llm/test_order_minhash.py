"""Order MinHash: numbered k-mers, order of picks, and the edit report."""

import hashlib
import random

import numpy as np

from panelgate.llm import order_minhash as om
from tests.llm.conftest import prose


def plain_sketch(text):
    values = om.numbered_kmers(text)
    if not len(values):
        return np.zeros(om.SKETCHES, np.uint64)
    out = []
    for f in om._FACTORS:
        hashed = f * (values ^ (values >> np.uint64(33)))
        picked = sorted(sorted(range(len(values)), key=lambda i: hashed[i])[: om.PICKED])
        h = np.array([om._GOLD])
        for i in picked:
            h = om._mixed(h * om._MIX + values[i])
        out.append(h[0])
    return np.array(out, np.uint64)


def test_sketch_equals_plain_one(monkeypatch):
    rng = random.Random(1)
    texts = [b"", b"a", b"abcdefgh", b"abcdefghi", b"ab" * 300, b"\0" * 50, prose(rng, 300).encode()]
    for step in (om.STEP, 16, 1):
        monkeypatch.setattr(om, "STEP", step)
        for text in texts:
            assert (om.sketch(text) == plain_sketch(text)).all()


def test_kmers_are_numbered():
    assert len(set(om.numbered_kmers(b"a" * 100).tolist())) == 93
    a, b = om.numbered_kmers(b"abcdefgh12345678"), om.numbered_kmers(b"12345678abcdefgh")
    assert len(set(a.tolist()) & set(b.tolist())) == 2


def test_moved_halves_lower_the_likeness():
    rng = random.Random(2)
    one, two = prose(rng, 300).encode(), prose(rng, 300).encode()
    moved = om.likeness(om.sketch(one + two), om.sketch(two + one))
    changed = om.likeness(om.sketch(one + two), om.sketch(one + two[:-9] + b"different"))
    assert moved < 0.8 < changed
    assert om.likeness(om.sketch(one), om.sketch(two)) < 0.1


def plain_report(rows):
    """Rows in descending order; every document is edited with the next one's text."""
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1] or ""
        text = text or ""
        changed = om.edited(text, following).encode()
        own, other, after = om.sketch(text.encode()), om.sketch(changed), om.sketch(following.encode())
        out.append((i, len(text), hashlib.sha256(changed).hexdigest(), om.fingerprint(own),
                    om.fingerprint(other), om.likeness(own, other), om.likeness(own, after)))
    return out


def test_report_equals_brute_force(docs, corpus):
    rows = sorted(((c[0], c[1]) for c in corpus), reverse=True)
    found = sorted(map(tuple, om.edit_report(docs).collect()), reverse=True)
    assert found == plain_report(rows)


def test_report_of_few_rows(spark):
    for rows in ([(1, "abc def ghi")], [(2, "x" * 30), (1, None)], [(3, ""), (2, "é" * 20), (1, "a\0b")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, om.edit_report(docs).collect()), reverse=True) == plain_report(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = om.edit_report(odd_docs).collect()
    assert len(rows) == 7
    assert len({r.fingerprint for r in rows if r.doc_id == 5}) == 1
    assert om.edit_report(no_docs).collect() == []
    assert om.fingerprints(odd_docs).count() == 7


def test_an_id_of_many_rows_is_cut_by_its_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(om, "RANGE_ROWS", 8)
    rng = random.Random(4)
    ids = [7] * 150 + [None] * 120 + list(range(100)) + [-5] * 40
    rows = [(i, prose(rng, 12)) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    hashes = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    ordered = sorted(hashes, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)
    wanted = plain_report([(r.doc_id, r.text) for r in ordered])
    found = [tuple(r) for r in om.edit_report(docs).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    ranges = om.in_ranges(docs).filter("not head").groupBy("range").count().collect()
    assert sum(r["count"] for r in ranges) == len(rows)
    assert max(r["count"] for r in ranges) <= 40
