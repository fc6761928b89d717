"""SimHash fingerprints, bit-sliced comparison and components against brute force."""

import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from panelgate.llm import simhash
from panelgate.llm.common import star_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_components_equal_brute_force(docs, corpus):
    rows = sorted(corpus)
    fps = [plain_fingerprint(r[1]) for r in rows]
    found = {r.doc_id: r for r in simhash.components(docs).collect()}
    assert len(found) == len(rows)
    assert [found[r[0]].fp & (2**64 - 1) for r in rows] == fps
    expected = [rows[i][0] for i in plain_components(fps)]
    assert [found[r[0]].component_id for r in rows] == expected


def test_bit_sliced_links_equal_brute_force():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base:
        for _ in range(5):
            x = b
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    fps = np.array(sorted(values), np.uint64)
    alive, rows = simhash.near(fps)
    bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
    got = {(int(alive[i]), int(j)) for i, j in zip(*np.nonzero(bits))}
    want = {
        (i, j) for i in range(len(fps)) for j in range(len(fps))
        if i != j and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4
    }
    assert got == want


def test_hot_bucket_is_dealt_out_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 64)
    rng = random.Random(2)
    values = {0}
    for _ in range(300):
        x = 0
        for _ in range(rng.randint(1, 9)):
            x ^= 1 << rng.randrange(40)
        values.add(x)
    fps = sorted(values)
    table = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    stars = dict(star_components(simhash.links(table, 5)).collect())
    groups = plain_components(fps)
    found = {}
    for x, g in zip(fps, groups):
        found.setdefault(g, set()).add(stars.get(x, x))
    assert all(len(v) == 1 for v in found.values())
    assert len({next(iter(v)) for v in found.values()}) == len(found)


def test_masks_leave_a_block_for_every_link():
    rng = random.Random(3)
    for blocks in (5, 6, 8):
        masks = simhash.masks(blocks)
        for _ in range(50):
            changed = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(changed & m == 0 for m in masks)


def test_one_of_each_keeps_one_row_of_a_group(docs, corpus, odd_docs, no_docs):
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    found = simhash.components(docs).collect()
    assert kept == {r.component_id for r in found}
    assert simhash.one_of_each(docs).count() == len(kept)
    odd = simhash.one_of_each(odd_docs)
    assert odd.columns == odd_docs.columns
    rows = sorted((r.doc_id, r.text) for r in odd.collect())
    assert [(i, t[:5]) for i, t in rows] == [(3, ""), (3, "x"), (5, "Alpha")]
    assert simhash.one_of_each(no_docs).count() == 0


def test_rows_without_id_or_text(odd_docs, no_docs):
    found = simhash.components(odd_docs).collect()
    assert len(found) == 7
    assert all(r.component_id == 5 for r in found if r.doc_id is None and r.fp)
    assert {r.component_id for r in found if r.fp == 0} == {3}
    assert len({r.root for r in found}) == 3
    assert simhash.components(no_docs).collect() == []


def test_star_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = dict(star_components(edges).collect())
    assert {roots[i] for i in range(41)} == {0}
    assert roots[101] == roots[100] == 100
    assert star_components(edges.filter("a < 0")).count() == 0
