"""Document quality by labelling lines: content or boilerplate.

A linear-chain conditional random field scores the lines of a text by their own
features and by their neighbours' labels; Viterbi decoding finds the best labelling.
A document is kept when enough of its words stand in content lines. The field is
fitted on a bounded sample of documents with a quality label.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgate.llm.common import text_rows

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 50, 50, 3

# Production parameters: share of words in content lines that keeps a document, and
# the bounds of the training sample (documents of each label, lines of a document).
KEEP_SHARE, TRAIN_DOCS, TRAIN_LINES = 0.5, 500, 64

FEATURES = (
    "bias", "log_words", "symbols_per_word", "upper_share", "exclamations_per_word",
    "digits_per_char", "repeats_a_line", "repeated_words", "long_words", "ends_a_sentence",
)

# Weights the fit starts from and is drawn to: with no labelled document they decide.
PRIOR = {
    "emission": np.array([2.0, 0.2, -4.0, -4.0, -3.0, -2.0, -1.5, -4.0, -1.0, 0.5]),
    "transition": np.array([[0.5, 0.0], [0.0, 0.5]]),
}

_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"


def _less(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def line_features(line: bytes, words: list[bytes], seen_before: bool) -> tuple:
    """Values of ``FEATURES`` for a line that has a word."""
    n = len(words)
    letters = _less(line, _LETTERS)
    return (
        1.0,
        np.log1p(n),
        min(_less(line, SYMBOLS) / n, 2.0),
        _less(line, _UPPER) / letters if letters else 0.0,
        min(line.count(b"!") / n, 2.0),
        _less(line, _DIGITS) / len(line),
        float(seen_before),
        1.0 - len(set(words)) / n if n > 3 else 0.0,
        float(len(line) > 16 * n),
        float(line.rstrip()[-1:] in b".!?"),
    )


def lines_of(text: bytes, most: int | None = None):
    """Features and word counts of the lines with a word, and the number of repeated lines."""
    seen, features, counts, repeated = set(), [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        again = line in seen
        seen.add(line)
        repeated += again
        features.append(line_features(line, words, again))
        counts.append(len(words))
        if most is not None and len(counts) == most:
            break
    return features, counts, repeated


def repeated_words(words: list[bytes]) -> int:
    """Words inside some window of three words that the text has twice or more."""
    if len(words) <= WINDOW:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    key = ids[: 1 - WINDOW]
    for i in range(1, WINDOW):
        # Ranks of the windows so far keep the combined key below 2^63.
        if i > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(known) + ids[i : len(ids) + 1 - WINDOW + i]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    sorted_hit, hit = np.zeros(len(key), bool), np.zeros(len(key), bool)
    sorted_hit[1:] |= same
    sorted_hit[:-1] |= same
    hit[order] = sorted_hit
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : i + len(key)] |= hit
    return int(covered.sum())


def viterbi(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best labels (1: content) for scores ``emission[i]`` of content against boilerplate."""
    n = len(emission)
    labels = np.zeros(n, np.int8)
    if not n:
        return labels
    (t00, t01), (t10, t11) = transition.tolist()
    score0, score1, back = 0.0, float(emission[0]), []
    for e in emission[1:].tolist():
        a, b = score0 + t00, score1 + t10
        c, d = score0 + t01, score1 + t11
        back.append((b > a, d >= c))
        score0, score1 = (b if b > a else a), (d if d >= c else c) + e
    label = score1 >= score0
    labels[-1] = label
    for i in range(n - 2, -1, -1):
        label = back[i][label]
        labels[i] = label
    return labels


def fit(sequences: list[tuple[np.ndarray, int]], steps: int = 200, pull: float = 1.0) -> dict:
    """Field fitted on ``(line features, document quality)``, drawn to ``PRIOR``.

    A poor document may hold good lines. So a first fit without transitions takes
    every line for as good as its document; then the lines of poor documents that
    it finds good are relabelled, and emissions and transitions are fitted together.
    """
    if not sequences:
        return PRIOR
    longest = max(len(f) for f, _ in sequences)
    x = np.zeros((len(sequences), longest, len(FEATURES)))
    here = np.zeros((len(sequences), longest), bool)
    y = np.zeros((len(sequences), longest), np.int64)
    for i, (f, quality) in enumerate(sequences):
        x[i, : len(f)], here[i, : len(f)], y[i, : len(f)] = f, True, quality
    alone = _ascend(x, here, y, {**PRIOR, "transition": np.zeros((2, 2))}, steps, pull, False)
    poor = np.array([quality == 0 for _, quality in sequences])[:, None]
    y = np.where(poor & (x @ alone["emission"] > 0), 1, y)
    return _ascend(x, here, y, {**PRIOR, "emission": alone["emission"]}, steps, pull, True)


def _ascend(x, here, y, start, steps, pull, chained):
    w, t = start["emission"].copy(), start["transition"].copy()
    n = max(1, int(here.sum()))
    both = here[:, 1:] & here[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, steps + 1):
        content, pairs = _marginals(x @ w, t, here)
        grad_w = ((y - content) * here).ravel() @ x.reshape(-1, x.shape[2]) / n
        grad_w -= pull * (w - PRIOR["emission"]) / n
        grad_t = (seen - pairs - pull * (t - PRIOR["transition"])) / n
        for k, (value, grad) in enumerate(((w, grad_w), (t, grad_t))):
            if k and not chained:
                continue
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"emission": w, "transition": t}


def _marginals(score, t, here):
    """Probability of content at every line, expected label pairs over all sequences."""
    n, length = score.shape
    e = np.stack([np.zeros_like(score), score], axis=2)
    forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    forward[:, 0] = e[:, 0]
    for i in range(1, length):
        step = forward[:, i - 1, :, None] + t[None]
        forward[:, i] = np.where(
            here[:, i, None], np.logaddexp(step[:, 0], step[:, 1]) + e[:, i], forward[:, i - 1]
        )
    for i in range(length - 2, -1, -1):
        step = (backward[:, i + 1] + e[:, i + 1])[:, None, :] + t[None]
        ahead = np.logaddexp(step[:, :, 0], step[:, :, 1])
        backward[:, i] = np.where(here[:, i + 1, None], ahead, 0.0)
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    content = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
    pairs = (
        forward[:, :-1, :, None] + t[None, None]
        + (e + backward)[:, 1:, None, :] - total[:, None, None, None]
    )
    both = here[:, 1:] & here[:, :-1]
    return content, np.exp(pairs[both]).sum(axis=0)


def train(docs: DataFrame, labels: DataFrame, docs_of_each: int = TRAIN_DOCS,
          lines: int = TRAIN_LINES) -> dict:
    """Field fitted on at most ``docs_of_each`` labelled documents of either quality.

    The sample is the first by a hash of the id, so reruns agree. Of a sampled
    document the first ``lines`` lines are used. Rows without label are left out.
    """
    chosen = None
    for quality in (0, 1):
        some = (
            labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull())
            .select("doc_id", F.col("quality").cast("long").alias("quality")).distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_of_each)
        )
        chosen = some if chosen is None else chosen.union(some)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [np.array(lines_of(t, lines)[0]).ravel().tolist() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality"), pa.array(found, pa.list_(pa.float64()))],
                ["quality", "found"],
            )

    # At most twice ``docs_of_each`` rows of two numbers.
    texts = text_rows(docs).join(F.broadcast(chosen), "doc_id")
    first = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "quality")
    first = first.select("quality", "text").limit(2 * docs_of_each)
    rows = first.mapInArrow(run, "quality long, found array<double>").collect()
    rows = [r for r in rows if r["found"]]
    return fit([(np.array(r["found"]).reshape(-1, len(FEATURES)), r["quality"]) for r in rows])


def judge(text: bytes, field: dict) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, share, kept``."""
    words = text.split()
    features, counts, repeated = lines_of(text)
    again = repeated_words(words)
    n = len(words)
    failed = n < LEAST_WORDS or 100 * again > REPEATED_PERCENT * n
    share = 0.0
    if n:
        content = viterbi(np.array(features) @ field["emission"], field["transition"])
        share = float(np.dot(content, counts)) / n
    chars = len(text) - _less(text, _CONTINUATION) - _less(text, _SPACE)
    return (
        n, chars, _less(text, SYMBOLS), repeated, again, failed, share,
        not failed and share >= KEEP_SHARE,
    )


def quality(docs: DataFrame, field: dict) -> DataFrame:
    """Per row: ``doc_id``, the base counts, ``base_failed``, ``content_share`` and ``kept``.

    A null text counts as an empty one: no words, so the base rule fails it. Repeated
    rows are judged alike; an empty table gives none. Texts are labelled whole, however
    many lines they have; of equally good labellings the last line is content, and each
    line before it labelled like the one after it.
    Columns other than ``doc_id`` and ``text`` are not read, whatever their names.
    """
    rows = text_rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names)
    schema += ", base_failed boolean, content_share double, kept boolean"

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            columns = list(zip(*[judge(t, field) for t in texts])) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", *names, "base_failed", "content_share", "kept"],
            )

    return rows.mapInArrow(run, schema)


def good_documents(docs: DataFrame, field: dict) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns, in one pass."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([judge(t or b"", field)[-1] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
