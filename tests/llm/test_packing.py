"""Packing: ids as the tokenizer's own, gapless sequences, little padding."""

import zlib

import numpy as np
import pytest

from panelgate.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def own_ids(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array(e.ids + [packing.END_ID], "<u4") for e in found]


def check(rows, corpus):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for (doc_id, *_), ids in zip(corpus, own_ids([c[1] for c in corpus])):
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def sequences_are_gapless(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_pieces_and_places(docs, corpus):
    rows = packing.pack(docs, PATH).collect()
    check(rows, corpus)
    n = sequences_are_gapless(rows, packing.CAPACITY)
    tokens = sum(r.length for r in rows)
    assert n <= -(-tokens // packing.CAPACITY) + 1


@pytest.mark.parametrize("text", [
    "a<|endoftext|>b <|startoftext|>", "a<|ENDOFTEXT|>b <|StartOfText|> C", "İstanbul ﬁ é ẛ̣", "tab\tnew\nline\x0bvt\x1cfs\x85nel em",
    "don't we'll I'M", "日本語 テキスト 123456", "x" * 5000, "a ́b", "Σας ΣΑΣ",
    "it's. it'S!! 's.. a'.' ...x… x….. é*** 5.5% (a) a-b_c @s \"q\"", "rock'n'roll'",
])
def test_word_memory_changes_nothing(text):
    encode = packing.WordIds(PATH)
    for _ in range(2):
        assert encode([text.encode(), b"a b.", b""])[0].tolist() == own_ids([text])[0][:-1].tolist()


def test_patterns_hold_the_histogram():
    rng = np.random.default_rng(0)
    for capacity, histogram in (
        (2048, dict(zip(range(1, 2049), rng.integers(0, 50, 2048).tolist()))),
        (64, {1: 1000}), (64, {33: 10}), (64, {64: 3, 1: 1}), (10, {7: 5, 3: 4, 2: 9}), (8, {}),
    ):
        histogram = {k: v for k, v in histogram.items() if v}
        found = packing.patterns(histogram, capacity)
        placed = {}
        for pattern, packs in found:
            assert packs > 0 and sum(k * v for k, v in pattern.items()) <= capacity
            for k, v in pattern.items():
                placed[k] = placed.get(k, 0) + v * packs
        assert placed == histogram
        assert len(found) <= 3 * max(1, len(histogram))
    assert len(packing.patterns({64: 3, 1: 1}, 64)) == 2


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, PATH, ids=True).collect()
    sequences_are_gapless(rows, packing.CAPACITY)
    assert len(rows) == 7
    assert sorted(len(r.ids) for r in rows)[:3] == [1, 1, 1]
    assert packing.pack(no_docs, PATH).collect() == []
