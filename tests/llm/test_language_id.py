"""Language identification: forward-backward, held-out accuracy, code-switched text."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgate.llm import language_id as li

SYLLABLES = {
    "aa": ["ba", "bo", "bi", "the", "ing", "er"], "bb": ["ku", "kä", "sch", "ung", "ein"],
    "cc": ["ço", "eau", "le", "oué", "re"],
}
SCHEMA = "doc_id long, text string, lang string, source string, held_out int, score int, h int, n int"


def text(dice, language, words):
    return " ".join(
        "".join(dice.choice(SYLLABLES[language]) for _ in range(dice.randint(1, 4)))
        for _ in range(words)
    )


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(2)
    out = []
    for i in range(240):
        lang = dice.choice(["aa", "aa", "bb", "cc"])
        out.append((i, text(dice, lang, dice.randint(5, 80)).capitalize() + ".", lang, "s"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def field(docs):
    return li.train(docs)


def test_held_out_accuracy(docs, field, rows):
    found = {r.doc_id: r for r in li.predict(docs, field).collect()}
    assert field.languages == ["aa", "bb", "cc"]
    assert len(found) == len(rows)
    held = [r for r in rows if found[r[0]].held_out]
    assert 30 < len(held) < 90
    assert sum(found[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_held_out_labels_are_not_learned_from(docs):
    other = docs.withColumn("lang", F.when(li.held_out(), "zz").otherwise(F.col("lang")))
    assert li.train(other).languages == ["aa", "bb", "cc"]
    moved = docs.withColumn("source", F.lit("other")).withColumn("n", F.lit(5))
    one, two = li.train(docs), li.train(moved)
    assert np.array_equal(one.emission, two.emission)


def test_words_of_switched_text_get_their_own_language(field):
    dice = random.Random(9)
    first, second = text(dice, "aa", 15).split(), text(dice, "bb", 15).split()
    found = li.label_words(first + second, field)
    assert found.count("aa") + found.count("bb") == 30
    assert sum(a == b for a, b in zip(found, ["aa"] * 15 + ["bb"] * 15)) >= 28
    # Staying is likelier than changing, so an undecided word goes with its neighbours.
    assert (field.transition.diagonal() > field.transition.max(axis=1) - 1e-9).all()


def brute_force(emit, transition):
    n, k = emit.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        weight = np.prod([emit[i, c] for i, c in enumerate(labels)])
        weight *= np.exp(sum(transition[a, b] for a, b in zip(labels, labels[1:])))
        for i, c in enumerate(labels):
            out[i, c] += weight
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_equal_the_sum_over_all_labellings():
    dice = np.random.default_rng(4)
    transition = dice.standard_normal((3, 3))
    sizes = np.array([4, 1, 6, 4, 2])
    emit = np.exp(dice.standard_normal((sizes.sum(), 3)))
    found = li.marginals(emit, transition, sizes)
    ends = np.cumsum(sizes)
    for end, size in zip(ends, sizes):
        assert np.allclose(found[end - size : end], brute_force(emit[end - size : end], transition))


def test_gradient_is_that_of_the_likelihood():
    dice = np.random.default_rng(5)
    transition = dice.standard_normal((2, 2))
    scores = dice.standard_normal((1, 4, 2))
    labels, here = np.array([[0, 1, 1, 0]]), np.ones((1, 4), bool)

    def likelihood(s, t):
        total = np.logaddexp.reduce([
            sum(s[0, i, c] for i, c in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:]))
            for path in itertools.product(range(2), repeat=4)
        ])
        path = labels[0]
        return sum(s[0, i, c] for i, c in enumerate(path)) + sum(
            t[a, b] for a, b in zip(path, path[1:])) - total

    wrong, pairs = li._gradient(scores, transition, labels, here)
    step = 1e-6
    for i, c in itertools.product(range(4), range(2)):
        moved = scores.copy()
        moved[0, i, c] += step
        slope = (likelihood(moved, transition) - likelihood(scores, transition)) / step
        assert abs(slope + wrong[0, i, c]) < 1e-4
    for a, b in itertools.product(range(2), range(2)):
        moved = transition.copy()
        moved[a, b] += step
        slope = (likelihood(scores, moved) - likelihood(scores, transition)) / step
        assert abs(slope - pairs[a, b]) < 1e-4


def test_odd_texts_ids_and_tables(spark, docs, field):
    dice = random.Random(3)
    long_text = text(dice, "bb", 30_000)
    odd = [(1, None), (2, ""), (3, " 12 ²³ _ ,"), (None, "the ing ba"), (None, None),
           (7, "schung ein"), (7, "schung ein"), (8, long_text), (9, "é" * 5000)]
    df = spark.createDataFrame([(i, t, None, None, 0, 0, 0, 0) for i, t in odd], SCHEMA)
    found = li.predict(df, field).collect()
    assert len(found) == len(odd)
    undetermined = [(r.doc_id, r.score) for r in found if r.lang_pred == "und"]
    assert sorted(undetermined, key=repr) == sorted([(1, 0.0), (2, 0.0), (3, 0.0), (None, 0.0)], key=repr)
    assert [r.lang_pred for r in found if r.doc_id in (7, 8)] == ["bb"] * 3
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    assert li.train(df) is None
    assert {r.lang_pred for r in li.predict(docs, None).collect()} == {"und"}
    nothing = docs.limit(0)
    assert li.train(nothing) is None
    assert li.predict(nothing, field).collect() == []
