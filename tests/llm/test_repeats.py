"""Removal of repeated strings against brute force over every position."""

import hashlib
import random

import numpy as np
import pytest

from panelgate.llm import repeats


def plain(rows, length):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                gone[at : at + length] = True
            seen.add(window)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc_id] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def strings():
    rng = random.Random(1)

    def piece(n):
        return "".join(rng.choice("abcde ") for _ in range(n))

    shared = [piece(rng.choice([60, 99, 100, 101, 130, 250, 400])) for _ in range(10)]
    rows = [(0, "a" * 500), (1, "ab" * 300), (2, None), (3, ""), (4, "a" * 99), (5, "é" * 120), (6, "xyzé" * 60)]
    for i in range(7, 90):
        parts = [rng.choice(shared) if rng.random() < 0.6 else piece(rng.randint(1, 150)) for _ in range(rng.randint(1, 8))]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[20 + i][1]) for i in range(6)]
    return rows + [(300, piece(30_000) + shared[0])]


@pytest.mark.parametrize("group, spread_from", [(2_000, 32), (3, 32), (2_000, 2), (3, 2), (4, 4)])
def test_equals_brute_force(spark, monkeypatch, group, spread_from):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "SPREAD_FROM", spread_from)
    monkeypatch.setattr(repeats, "TEXT_BYTES", 5_000)
    rows = strings()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = repeats.strip_repeats(docs, texts=True).collect()
    want = plain(rows, repeats.LENGTH)
    assert {r.doc_id: tuple(r)[1:5] for r in found} == want
    assert len(found) == len(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


def test_a_gram_of_every_document_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SPREAD_FROM", 4)
    monkeypatch.setattr(repeats, "GROUP", 10)
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdef ") for _ in range(140))

    def own():
        return "".join(rng.choice("ghijkl ") for _ in range(120))

    rows = [(i, own() + shared + own()) for i in range(160)] + [(200, own())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    seen = {}

    def spied(df, name):
        seen[name] = kept = materialize(df, name)
        return kept

    materialize = repeats.materialize
    monkeypatch.setattr(repeats, "materialize", spied)
    found = {r.doc_id: tuple(r)[1:5] for r in repeats.strip_repeats(docs).collect()}
    assert found == plain(rows, repeats.LENGTH)
    open_rows = seen["repeats"].filter(f"state = {repeats.OPEN}")
    shares = open_rows.groupBy("gram", "share").count().collect()
    by_gram = open_rows.groupBy("gram").count().collect()
    # A gram at an end of the passage has about as many surroundings as there are documents.
    assert max(r["count"] for r in by_gram) >= 120
    assert max(r["count"] for r in shares) <= 40


def test_classes_of_anchors_in_chunks(monkeypatch):
    text = (random.Random(2).randbytes(3000) * 2)[:5000]
    whole = repeats.anchors(text)
    monkeypatch.setattr(repeats, "_PLACES", 10)
    cut = repeats.anchors(text)
    # Smaller chunks leave more bits of the class to decide, so only the cover is the same.
    for gram, first, last, place in (whole, cut):
        assert first[0] == 0 and last[-1] == len(text) - repeats.LENGTH
        assert (first[1:] == last[:-1] + 1).all()
        assert (place >= last).all() and (place + repeats.GRAM <= first + repeats.LENGTH).all()


def test_rank_classes_equal_strings():
    text = b"abcabcabdabcabcabd" * 20
    for length in (8, 9, 24, 100):
        ranks = repeats.window_ranks(text, length)
        by_text = {}
        for i, r in enumerate(ranks.tolist()):
            by_text.setdefault(text[i : i + length], set()).add(r)
        assert all(len(v) == 1 for v in by_text.values())
        assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)


def test_rows_without_or_with_one_id(odd_docs, no_docs, spark):
    rows = repeats.strip_repeats(odd_docs).collect()
    assert len(rows) == 7
    # The row without an id comes first; both rows 5 are one document after it.
    by_id = sorted(((r.doc_id or -1, r.n_bytes, r.n_removed) for r in rows))
    text = [b for b in by_id if b[1] > 100]
    assert [b[0] for b in text] == [-1, 5, 5]
    assert text[0][2] < text[1][2] == text[2][2] == text[1][1]
    assert repeats.strip_repeats(no_docs).collect() == []
