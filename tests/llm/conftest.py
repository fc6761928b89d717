import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))


def prose(rng, n):
    lines = []
    while n > 0:
        m = min(n, rng.randint(8, 20))
        lines.append(" ".join(word(rng) for _ in range(m)).capitalize() + ".")
        n -= m
    return "\n".join(lines)


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: prose, copies, near copies, junk, nulls, empties, long texts."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(60, 200))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(8)]
    for i in range(8):
        words = rows[i + 10][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((120 + i, " ".join(words)))
    rows += [(140 + i, " ".join(w + "###" for w in prose(rng, 90).split())) for i in range(6)]
    rows += [(150, None), (151, ""), (152, "   \n\t "), (153, "one two"), (154, "é" * 3000)]
    rows += [(155, prose(rng, 6000)), (156, "word " * 500)]
    sources = ["a", "b", "B", "ä", None]
    return [(i, t, "en", sources[i % 5], len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC_SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Repeated rows, rows without id, and columns whose names operators might use."""
    text = "Alpha beta gamma delta epsilon zeta eta theta.\nToken = \"abcdef123456\" here.\n" * 4
    rows = [(5, text, "s"), (5, text, "s"), (None, text, "s"), (None, None, None), (3, "", "s"),
            (3, "x", None), (9, None, "t")]
    extra = "turn int, copies int, key int, held int, fp int, row int, component_id int, of int"
    return spark.createDataFrame(
        [(*r, 0, *[1] * 8) for r in rows],
        f"doc_id long, text string, source string, n_chars int, {extra}",
    )


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
