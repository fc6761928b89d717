"""Ranked lexical search against scoring every document."""

import collections
import math
import random
import re

import numpy as np
import pytest

from panelgate.llm import lexical_search as ls

DOCS, ITEMS = "doc_id long, text string, n int, item_id int, score int", "item_id long, text string, n int"


def brute_force(docs, items, k):
    def terms(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(ls.TERM, lowered)

    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    queries = {}
    for item, text in dict.fromkeys(items):
        queries.setdefault(item, collections.Counter()).update(terms(text))
    out = []
    for item, query in queries.items():
        found = []
        for (i, own), size in zip(counted, sizes):
            score = 0
            for term, c in query.items():
                tf = own.get(term, 0)
                if tf:
                    df = sum(term in o for _, o in counted)
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                    m = 75 + (25 * size * n) // total
                    score += c * w * ((10**9 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, missing, i) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if missing else i, -score))
    return sorted(out, key=repr)


def found(spark, docs, items, k=20, **options):
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    return sorted((tuple(r) for r in ls.search(d, q, k, **options).collect()), key=repr)


def corpus(seed, n_docs=150, n_items=8):
    dice = random.Random(seed)
    words = ["the", "Of", "é", "Ünit", "x9"] + [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(most):
        return dice.choice([" ", ", ", "\n"]).join(dice.choices(words, weights, k=dice.randint(1, most)))

    docs = [(i, text(60)) for i in range(n_docs)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(30)]
    docs += [(2000, None), (2001, ""), (2002, " ,.\t"), (None, "the w1 w2"), (None, None)]
    docs += [(5, docs[5][1]), (5, "w3 w3"), (3000, "the w7 " * 4000)]
    items = [(i, text(15)) for i in range(n_items)]
    items += [(0, items[0][1]), (1, "w1 w1 w2"), (50, None), (51, ""), (52, "nowhere"), (None, "w4 é")]
    return docs, items


@pytest.mark.parametrize("seed,k", [(1, 20), (2, 3)])
def test_equals_scoring_every_document(spark, seed, k):
    docs, items = corpus(seed)
    assert found(spark, docs, items, k) == brute_force(docs, items, k)


def test_blocks_of_items_change_nothing(spark):
    docs, items = corpus(3, 40)
    assert found(spark, docs, items, 5, pairs_at_once=12) == brute_force(docs, items, 5)


def test_empty_tables_have_no_rows(spark):
    docs, items = corpus(4, 10)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []


def lists_of(n_docs, impacts):
    """Impact lists of documents that all have every term."""
    n_terms = len(impacts)
    values = np.array(impacts, np.int64).T.ravel()
    return ls.ImpactLists(
        np.arange(n_docs + 1) * n_terms, np.tile(np.arange(n_terms, dtype=np.int32), n_docs),
        values, n_terms,
    )


def test_search_stops_before_the_lists_end():
    n = 1000
    falling = np.arange(n, 0, -1) ** 2
    lists = lists_of(n, [falling, falling])
    docs, scores = lists.search([(0, 1), (1, 2)], 3, [], np.full(2, -1))
    assert len(docs) < 100
    assert sorted(scores)[-3:] == [3 * 998**2, 3 * 999**2, 3 * 1000**2]


def test_best_positions_stop_earlier_than_last_reads():
    # The second list ranks the same documents shifted by one: after two reads a direct
    # access has already seen further than the reads themselves.
    n = 64
    first, second = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[:] = np.arange(n, 0, -1) * 10
    second[1:] = np.arange(n - 1, 0, -1) * 10 + 10
    second[0] = 10
    docs, _ = lists_of(n, [first, second]).search([(0, 1), (1, 1)], 1, [], np.full(2, -1), first=2)
    assert len(docs) < 10


def test_ties_at_the_bound_are_all_seen():
    lists = lists_of(500, [np.full(500, 7)])
    docs, _ = lists.search([(0, 1)], 3, [], np.full(1, -1))
    assert len(docs) == 500


def test_known_scores_end_a_search_sooner():
    falling = np.arange(1000, 0, -1)
    lists, slot = lists_of(1000, [falling]), np.full(1, -1)
    assert len(lists.search([(0, 1)], 2, [5000, 5000], slot)[0]) == ls.FIRST_ROUND
    assert (slot == -1).all()
