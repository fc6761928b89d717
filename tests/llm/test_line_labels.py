"""Line labels: base counts, Viterbi and the fitted field."""

import itertools
import random
import re
from collections import Counter

import numpy as np

from panelgate.llm import line_labels
from tests.llm.conftest import prose


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {
        k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1
        for k in (i, i + 1, i + 2)
    }
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), failed)


def base(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_base_counts_equal_plain_ones(docs, corpus):
    found = {r.doc_id: r for r in line_labels.quality(docs, line_labels.PRIOR).collect()}
    assert len(found) == len(corpus)
    for doc_id, text, *_ in corpus:
        assert base(found[doc_id]) == plain_base(text)
        assert not (found[doc_id].base_failed and found[doc_id].kept)


def test_repeated_words_at_random():
    rng = random.Random(5)
    for _ in range(200):
        text = " ".join(rng.choice("ab c d".split()) for _ in range(rng.randint(0, 30)))
        assert line_labels.repeated_words([w.encode() for w in text.split()]) == plain_base(text)[4]


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(4)
    for n in range(1, 9):
        emission, transition = rng.normal(size=n), rng.normal(size=(2, 2))

        def score(labels):
            chain = sum(transition[a, b] for a, b in zip(labels, labels[1:]))
            return chain + sum(e for e, x in zip(emission, labels) if x)

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(line_labels.viterbi(emission, transition)) == best
    assert len(line_labels.viterbi(np.zeros(0), np.zeros((2, 2)))) == 0


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(6)
    score, transition = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    here = np.array([[True, True, True, False]])
    content, pairs = line_labels._marginals(score, transition, here)
    weights = {
        x: np.exp(sum(s for s, y in zip(score[0], x) if y) + sum(transition[a, b] for a, b in zip(x, x[1:])))
        for x in itertools.product((0, 1), repeat=3)
    }
    total = sum(weights.values())
    for i in range(3):
        assert np.isclose(content[0, i], sum(w for x, w in weights.items() if x[i]) / total)
    for a, b in itertools.product((0, 1), repeat=2):
        want = sum(w * sum(p == (a, b) for p in zip(x, x[1:])) for x, w in weights.items()) / total
        assert np.isclose(pairs[a, b], want)


def test_fitted_field_keeps_clean_and_drops_junk(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(120):
        text, quality = prose(rng, 120), i % 4 != 0
        if not quality:
            text = text.split("\n")[0] + "\n" + "\n".join(
                " ".join(w + rng.choice(["###", "$$$", "***"]) for w in line.split())
                for line in text.split("\n")[1:]
            )
        rows.append((i, text))
        labels.append((i, int(quality), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels[:80], "doc_id long, quality int, toxic int")
    field = line_labels.train(docs, marks)
    kept = {r.doc_id: r.kept for r in line_labels.quality(docs, field).collect()}
    assert [kept[i] for i in range(80, 120)] == [i % 4 != 0 for i in range(80, 120)]
    again = line_labels.train(docs.repartition(5), marks)
    assert np.allclose(field["emission"], again["emission"])


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(5, 1, 0), (None, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    field = line_labels.train(odd_docs, labels)
    assert line_labels.train(odd_docs, labels.filter("false")) is line_labels.PRIOR
    assert line_labels.quality(odd_docs, field).count() == 7
    kept = line_labels.good_documents(odd_docs, field)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r.kept for r in line_labels.quality(odd_docs, field).collect())
    assert line_labels.quality(no_docs, field).collect() == []
    assert line_labels.good_documents(no_docs, field).collect() == []
