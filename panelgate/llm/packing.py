"""Packing of tokenized documents into sequences of fixed capacity.

Shortest-pack-first over the histogram of piece lengths: lengths are placed from
the longest down, each into the least filled packs that still have room, counting
how often every packing pattern occurs. Only the histogram, at most one row per
length, reaches the driver. Pieces get their place from their rank among the
pieces of their length, joined with the patterns' runs of ranks.
"""

import array
import heapq
import itertools
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgate.llm.common import materialize, text_rows

CAPACITY = 2048

# The id that ends a document, and strings the tokenizer treats as one token.
END_ID = 1
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")

# ASCII signs that a tokenizer splits from a letter or digit before them. The apostrophe
# is not among them, as it may start a token of its own with what follows.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

# The tokenizer writes bytes as signs: visible Latin-1 ones as themselves, the others
# in order as the signs from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {
    b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)
}

# Words remembered per worker, some 100 MB; beyond it the memory starts anew.
REMEMBERED = 500_000

# Words that are encoded as one text.
JOINED = 1000


class _Numbers(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer lowers letters and never joins characters across ASCII white space,
    nor a letter or digit and signs behind it. So the ids of a text are those of its
    words in turn, and a word, or its letters and signs, is encoded once. Sent as a
    broadcast, one memory serves all tasks of a worker; it starts empty in each.
    """

    def __init__(self, path):
        self.path, self.tokenizer = path, None

    def __getstate__(self):
        return {"path": self.path, "tokenizer": None}

    def _forget(self):
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            # Each task works on its own core.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.tokenizer = Tokenizer.from_file(self.path)
        self.words, self.parts = _Numbers(), {b"": b""}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.tokenizer is None or len(self.words) > REMEMBERED:
            self._forget()
        number, known = self.words.__getitem__, len(self.words)
        numbered = []
        for text in texts:
            lowered = text.lower()
            # Also in capitals, where they are ordinary text that must not be lowered first.
            if any(s in lowered for s in SPECIAL):
                numbered.append(None)
                continue
            words = lowered.split()
            numbered.append(np.fromiter(map(number, words), np.int64, len(words)))
        self._learn(list(itertools.islice(self.words, known, None)))
        return [
            self._whole(text) if n is None else self._joined(n)
            for text, n in zip(texts, numbered)
        ]

    def _joined(self, numbers):
        starts, ends = self.ends[numbers], self.ends[numbers + 1]
        lengths = ends - starts
        upto = np.cumsum(lengths)
        total = int(upto[-1]) if len(upto) else 0
        return self.ids[np.arange(total) + np.repeat(starts - upto + lengths, lengths)]

    def _learn(self, new):
        if not new:
            return
        stems, tails = [], []
        for word in new:
            stem = word
            if not word.isalpha():
                bare = word.rstrip(SIGNS)
                stem = bare if bare[-1:].isalnum() else word
            stems.append(stem)
            tails.append(word[len(stem) :])
        if len(self.parts) > REMEMBERED:
            self.parts = {b"": b""}
        parts = self.parts
        unknown = [p for p in dict.fromkeys(itertools.chain(stems, tails)) if p not in parts]
        mixed, tokens = [], self.tokenizer.model.tokenize
        for part in unknown:
            signs = part.decode()
            if not part.isalpha():
                if not signs.isalpha() or max(signs) >= "\u0130":
                    mixed.append(part)
                    continue
                # Letters of Western Europe are one piece that only has to be lowered; the
                # ASCII ones are so already, and stand for themselves.
                signs = signs.lower().encode().decode("latin-1").translate(BYTE_SIGNS)
            parts[part] = array.array("I", [t.id for t in tokens(signs)]).tobytes()
        parts.update(zip(mixed, self._encode(mixed)))
        found = [parts[stem] + parts[tail] for stem, tail in zip(stems, tails)]
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def _whole(self, text):
        ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return np.array(ids, np.uint32)

    def _encode(self, words):
        """Ids of each word. Many are encoded as one text and told apart by their places."""
        out = []
        for at in range(0, len(words), JOINED):
            some = [w.decode() for w in words[at : at + JOINED]]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            data = np.array(found.ids, "<u4").tobytes()
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            starts = np.cumsum(lengths + 1) - lengths - 1
            places = np.array([o[0] for o in found.offsets], np.int64)
            cuts = (4 * np.append(np.searchsorted(places, starts), len(places))).tolist()
            out += [data[i:j] for i, j in zip(cuts, cuts[1:])]
        return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False):
    """Every document's ids and the end id, cut after each ``capacity`` ids.

    Columns: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, with
    ``ids`` also the ids themselves; ``part`` and ``nth`` number the pieces of one
    length within the task that cut them.
    """
    rows = text_rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:])
    schema += ", ids array<long>" if ids else ""

    words = docs.sparkSession.sparkContext.broadcast(WordIds(tokenizer))

    def run(batches):
        encode, part, counted = words.value, TaskContext.get().partitionId(), Counter()
        for batch in batches:
            of, out, own_ids = [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for i, found in enumerate(encode(texts)):
                data = np.append(found, END_ID).astype("<u4").tobytes()
                for at in range(0, len(data), 4 * capacity):
                    piece = data[at : at + 4 * capacity]
                    n = len(piece) // 4
                    of.append(i)
                    out.append((at // 4, n, zlib.crc32(piece), len(data) // 4, part, counted[n]))
                    counted[n] += 1
                    if ids:
                        own_ids.append(np.frombuffer(piece, "<u4").astype(np.int64))
            columns = np.array(out, np.int64).reshape(-1, 6).T
            arrays = [batch.column("doc_id").take(pa.array(of, pa.int64()))]
            arrays += [pa.array(c) for c in columns]
            arrays += [pa.array(own_ids, pa.list_(pa.int64()))] if ids else []
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * ids)

    return rows.mapInArrow(run, schema)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict, int]]:
    """``({length: pieces in the pack}, packs)`` for a histogram ``{length: pieces}``.

    Each length splits at most one group of packs and opens at most two, so there
    are no more than three patterns per length.
    """
    open_, closed = [], []  # groups by free room, the least filled first
    count = 0

    def keep(room, pattern, packs):
        nonlocal count
        if room:
            heapq.heappush(open_, (-room, count, pattern, packs))
            count += 1
        else:
            closed.append((pattern, packs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_ and -open_[0][0] >= length:
            room, _, pattern, packs = heapq.heappop(open_)
            room = -room
            # A pack takes as many as fit, unless there are too few to give each one so many.
            each = max(1, min(room // length, left // packs))
            used = min(packs, left // each)
            if used < packs:
                keep(room, pattern, packs - used)
            keep(room - each * length, pattern | {length: pattern.get(length, 0) + each}, used)
            left -= used * each
        full = capacity // length
        for each, packs in ((full, left // full), (left % full, 1)):
            if each and packs:
                keep(capacity - each * length, {length: each}, packs)
    return closed + [(pattern, packs) for _, _, pattern, packs in sorted(open_)]


def runs(found: list[tuple[dict, int]]) -> list[tuple]:
    """The patterns' places as runs of ranks within a length.

    ``(length, lo, hi, each, first_sequence, first_offset)``: the pieces of ranks
    ``lo`` to ``hi - 1`` go ``each`` to a sequence, from ``first_offset`` on.
    """
    out, ranked, sequence = [], Counter(), 0
    for pattern, packs in found:
        offset = 0
        for length, each in pattern.items():
            lo = ranked[length]
            ranked[length] = lo + each * packs
            out.append((length, lo, ranked[length], each, sequence, offset))
            offset += length * each
        sequence += packs
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset``.

    A null text is an empty one and still has the end id; repeated rows are packed
    as often as they occur; an empty table gives none. Within a sequence the pieces
    follow each other without gaps from offset 0. A text of any length is cut into pieces;
    which of equally long pieces goes where follows from their place in the ranks. Columns
    other than ``doc_id`` and ``text`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity, ids), "pieces")
    counted = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = counted.select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    histogram = dict(counted.groupBy("length").agg(F.sum("n")).collect())
    places = spark.createDataFrame(
        runs(patterns(histogram, capacity)),
        "length long, lo long, hi long, each long, first_sequence long, first_offset long",
    )
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    # At most three patterns of 63 different lengths for each length: a bounded broadcast.
    placed = ranked.join(
        F.broadcast(places.withColumnRenamed("length", "run_length")),
        (F.col("length") == F.col("run_length"))
        & (F.col("rank") >= F.col("lo"))
        & (F.col("rank") < F.col("hi")),
    )
    turn = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.expr("(rank - lo) div each")).alias("sequence_id"),
        (F.col("first_offset") + turn % F.col("each") * F.col("length")).alias("offset"),
        *(["ids"] if ids else []),
    )
