"""Languages of texts by a linear-chain conditional random field over their words.

A word speaks for a language by its beginnings, its endings, the n-grams inside it and
the lexicons it stands in; learned transitions say how languages follow each other in
code-switched text. Forward-backward gives every word's probabilities, and a text's
language is the one with the largest expected number of words. The field is fitted on a
bounded sample of labelled texts, spliced into sequences that change language.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgate.llm.common import text_rows

# Documents with this remainder are held out; the language of no language.
HELD_OUT_OF, HELD_OUT, UNDETERMINED = 4, 2, "und"

# Production parameters. Bounds of the sample: labelled documents of a language, words of
# one, all documents. Of the field: feature places, lexicon words of a language, passes over
# the sequences and words of a sequence.
TRAIN_DOCS, TRAIN_WORDS, TRAIN_ALL = 200, 160, 6000
PLACES, LEXICON, PASSES, SEQUENCE = 1 << 16, 300, 5, 48

# Bounds of a task's memory: words that are remembered, words that are decoded together.
REMEMBERED, TOGETHER = 300_000, 1_000_000

_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; none where the runs hold only signs like a raised 2."""
    words = _RUN.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


class Places:
    """Places of a word's features in the table of weights, by a hash of the feature.

    With marks for its ends, a word has its n-grams of two and three signs and its
    beginnings and endings of four and five; beside these, the lexicons it stands in.
    """

    def __init__(self, lexicon: dict):
        self.lexicon, self.known = lexicon, {}

    def place(self, feature: str) -> int:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = self.known[feature] = zlib.crc32(feature.encode()) % PLACES
        return found

    def of(self, word: str) -> list[int]:
        marked = f"^{word}$"
        n = len(marked)
        parts = {marked[i : i + 3] for i in range(n - 2)}
        parts.update([marked[i : i + 2] for i in range(n - 1)])
        parts.update((marked[:4], marked[:5], marked[-4:], marked[-5:]))
        parts.update(self.lexicon.get(word, ("in no lexicon",)))
        get = self.known.get
        return [get(p) or self.place(p) for p in parts]


def marginals(emit, transition, sizes):
    """Label probabilities of every word of many sequences by forward-backward.

    ``emit`` holds the words' factors per label, sequence after sequence; ``sizes`` the
    sequences' lengths, none zero. Sequences go side by side, longest first, so a step
    handles all that are long enough.
    """
    n_labels = emit.shape[1]
    order = np.argsort(-sizes, kind="stable")
    length = sizes[order]
    start = (np.cumsum(sizes) - sizes)[order]
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    move = np.exp(transition)
    forward = np.empty_like(emit)
    state = emit[start]
    state /= state.sum(axis=1, keepdims=True)
    forward[start] = state
    for t in range(1, steps):
        at = start[: active[t]] + t
        state = (state[: active[t]] @ move) * emit[at]
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    backward = np.ones((0, n_labels))
    for t in range(steps - 1, -1, -1):
        now = active[t]
        whole = np.ones((now, n_labels))
        if len(backward):
            at = start[: len(backward)] + t + 1
            ahead = (backward * emit[at]) @ move.T
            whole[: len(backward)] = ahead / ahead.sum(axis=1, keepdims=True)
        backward = whole
        forward[start[:now] + t] *= backward
    return forward / forward.sum(axis=1, keepdims=True)


def _gradient(scores, transition, labels, here):
    """Of padded sequences: expected less seen labels, and transitions seen less expected."""
    n, length, k = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    emit[~here] = 1.0
    move = np.exp(transition)
    forward, backward = np.empty_like(emit), np.ones_like(emit)
    forward[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        step = (forward[:, t - 1] @ move) * emit[:, t]
        step /= step.sum(axis=1, keepdims=True)
        forward[:, t] = np.where(here[:, t, None], step, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = (backward[:, t + 1] * emit[:, t + 1]) @ move.T
        step /= step.sum(axis=1, keepdims=True)
        backward[:, t] = np.where(here[:, t + 1, None], step, 1.0)
    both = forward * backward
    both /= both.sum(axis=2, keepdims=True)
    pairs = (forward[:, :-1, :, None] * move) * (emit * backward)[:, 1:, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    follows = here[:, 1:] & here[:, :-1]
    seen = np.zeros((k, k))
    np.add.at(seen, (labels[:, :-1][follows], labels[:, 1:][follows]), 1)
    both[np.arange(n)[:, None], np.arange(length), labels] -= 1.0
    both[~here] = 0.0
    return both, seen - pairs[follows].sum(axis=0)


class Field:
    """Weights of a fitted field: ``languages``, ``lexicon``, emissions and transitions."""

    def __init__(self, languages, lexicon, emission, transition):
        self.languages, self.lexicon = languages, lexicon
        self.emission, self.transition = emission, transition

    def factors(self, words: list[str], places: Places) -> np.ndarray:
        """What words contribute for every label, one row each, the largest being 1."""
        found = [places.of(w) for w in words]
        sizes = np.array([len(f) for f in found])
        flat = self.emission[np.array([p for f in found for p in f])]
        scores = np.add.reduceat(flat, np.cumsum(sizes) - sizes, axis=0)
        return np.exp(scores - scores.max(axis=1, keepdims=True))


class Remembered(dict):
    """Number of every word that was asked for, with a table of their factors."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.places, self.new = field, Places(field.lexicon), []
        self.table = np.zeros((0, len(field.languages)))

    def __missing__(self, word):
        self.new.append(word)
        number = self[word] = len(self)
        return number

    def factors(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
            self.table = self.table[:0]
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.table = np.concatenate([self.table, self.field.factors(self.new, self.places)])
            self.new = []
        return self.table[numbers]


def spliced(samples: list[tuple[int, list[str]]], seed: int = 5) -> list[list[tuple[int, str]]]:
    """Sequences of labelled words: pieces of sampled texts in an order drawn by ``seed``.

    Half of the pieces are followed by the next piece of the same text, the others by
    one of any text, so changes of language are seen and stay rarer than none.
    """
    dice = np.random.default_rng(seed)
    texts = []
    for label, words in samples:
        pieces, at = [], 0
        while at < len(words):
            size = int(dice.integers(6, 25))
            pieces.append([(label, w) for w in words[at : at + size]])
            at += size
        texts.append(pieces)
    runs = []
    for pieces in texts:
        run = []
        for piece in pieces:
            run += piece
            if dice.random() < 0.5:
                runs.append(run)
                run = []
        if run:
            runs.append(run)
    flat = [pair for i in dice.permutation(len(runs)) for pair in runs[i]]
    return [flat[i : i + SEQUENCE] for i in range(0, len(flat), SEQUENCE)]


def lexicons(samples, n_languages: int, most: int = LEXICON) -> dict:
    """Word to features naming every language among whose ``most`` commonest words it is."""
    out: dict = {}
    for label in range(n_languages):
        counts: dict = {}
        for own, words in samples:
            if own == label:
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
        common = sorted((w for w in counts if counts[w] > 2), key=lambda w: (-counts[w], w))
        for w in common[:most]:
            out[w] = (*out.get(w, ()), f"lexicon {label}")
    return out


def fit(samples: list[tuple[str, list[str]]], passes: int = PASSES) -> Field | None:
    """Field fitted on ``(language, words)`` by stochastic gradients; none without a word."""
    samples = [(lang, words) for lang, words in samples if words]
    if not samples:
        return None
    languages = sorted({lang for lang, _ in samples})
    number = {lang: i for i, lang in enumerate(languages)}
    numbered = [(number[lang], words) for lang, words in samples]
    lexicon = lexicons(numbered, len(languages))
    sequences = spliced(numbered)
    k = len(languages)
    places_of = Places(lexicon)
    known = {w: places_of.of(w) for sequence in sequences for _, w in sequence}
    emission, transition = np.zeros((PLACES, k)), np.zeros((k, k))
    slope, slope_t = np.full((PLACES, k), 1e-2), np.full((k, k), 1e-2)
    dice = np.random.default_rng(11)
    for _ in range(passes):
        order = dice.permutation(len(sequences))
        for at in range(0, len(order), 32):
            batch = [sequences[i] for i in order[at : at + 32]]
            length = max(map(len, batch))
            labels = np.zeros((len(batch), length), np.int64)
            here = np.zeros((len(batch), length), bool)
            flat = []
            for i, sequence in enumerate(batch):
                here[i, : len(sequence)] = True
                labels[i, : len(sequence)] = [label for label, _ in sequence]
                flat += [known[w] for _, w in sequence]
            sizes = np.array([len(f) for f in flat])
            places = np.array([p for f in flat for p in f])
            scores = np.zeros((len(batch), length, k))
            scores[here] = np.add.reduceat(emission[places], np.cumsum(sizes) - sizes, axis=0)
            wrong, pairs = _gradient(scores, transition, labels, here)
            own, back = np.unique(places, return_inverse=True)
            spread = np.repeat(wrong[here], sizes, axis=0)
            grad = np.stack(
                [np.bincount(back, spread[:, c], len(own)) for c in range(k)], axis=1
            ) + 1e-3 * emission[own]
            slope[own] += grad * grad
            emission[own] -= 0.2 * grad / np.sqrt(slope[own])
            slope_t += pairs * pairs
            transition += 0.2 * pairs / np.sqrt(slope_t)
    return Field(languages, lexicon, emission, transition)


def held_out():
    """Whether a row's ``doc_id`` keeps it out of the training sample; null ids are in neither."""
    return F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF == HELD_OUT


def train(docs: DataFrame, docs_of_each: int = TRAIN_DOCS, most: int = TRAIN_ALL) -> Field | None:
    """Field fitted on at most ``docs_of_each`` labelled documents of every language.

    The sample is the first by a hash of id and text, so reruns agree; of a document the
    first ``TRAIN_WORDS`` words are used, of all languages together ``most`` documents.
    """
    labelled = docs.filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
        & ~held_out()
    )
    some = labelled.select(
        "doc_id", "lang", F.xxhash64("doc_id", "text").alias("h"),
        F.substring("text", 1, 24 * TRAIN_WORDS).alias("text"),
    )
    some = some.withColumn(
        "n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    ).filter(F.col("n") <= docs_of_each)
    rows = some.orderBy("n", "lang").limit(most).collect()
    rows.sort(key=lambda r: (r["lang"], r["n"]))
    return fit([(r["lang"], words_of(r["text"])[:TRAIN_WORDS]) for r in rows])


def expected_words(words_of_texts: list[list[str]], remembered: Remembered) -> np.ndarray:
    """Expected words of every language for each text; a text without a word has zeros."""
    sizes = np.array([len(w) for w in words_of_texts], np.int64)
    out = np.zeros((len(sizes), len(remembered.field.languages)))
    filled = np.flatnonzero(sizes)
    if len(filled):
        emit = remembered.factors([w for words in words_of_texts for w in words])
        found = marginals(emit, remembered.field.transition, sizes[filled])
        starts = np.cumsum(sizes[filled]) - sizes[filled]
        out[filled] = np.add.reduceat(found, starts, axis=0)
    return out


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """Per row ``doc_id, held_out, lang_pred, score`` and ``n_words``.

    The score is the predicted language's share of the text's expected words. A text that
    is null or has no letter is ``und`` with score 0, and so is every text if there was
    nothing to learn from. Texts count whole, however long; equal shares go to the first
    language by name. Rows without id are not held out and never learned from. Repeated rows
    come out alike, an empty table gives none; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    languages = field.languages if field else []
    together_at_most = 4 * TOGETHER // max(4, len(languages))

    def run(batches):
        remembered = Remembered(field) if field else None
        for batch in batches:
            texts = batch.column("text")
            preds, scores, counts = [], [], []
            together, n = [], 0
            for i in range(len(texts)):
                words = words_of(texts[i].as_py())
                together.append(words)
                n += len(words)
                counts.append(len(words))
                if n < together_at_most and i + 1 < len(texts):
                    continue
                if field is None:
                    preds += [UNDETERMINED] * len(together)
                    scores += [0.0] * len(together)
                else:
                    expected = expected_words(together, remembered)
                    best = expected.argmax(axis=1)
                    total = expected.sum(axis=1)
                    preds += [languages[b] if t else UNDETERMINED for b, t in zip(best, total)]
                    share = expected.max(axis=1) / np.where(total > 0, total, 1.0)
                    scores += share.tolist()
                together, n = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(counts, pa.int64())],
                ["doc_id", "held_out", "lang_pred", "score", "n_words"],
            )

    rows = text_rows(docs, F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    rows = rows.select("doc_id", "text", "held_out")
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_words long"
    return rows.mapInArrow(run, schema)


def label_words(words: list[str], field: Field) -> list[str]:
    """Language of every word of one text, by the largest marginal probability."""
    if not words:
        return []
    emit = field.factors(words, Places(field.lexicon))
    found = marginals(emit, field.transition, np.array([len(words)]))
    return [field.languages[i] for i in found.argmax(axis=1)]
