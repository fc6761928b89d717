"""Order MinHash: document fingerprints sensitive to edit distance.

Of the occurrence-numbered k-mers of a text each of ``SKETCHES`` hash functions picks
the ``PICKED`` smallest; the picked k-mers keep their order in the text and are hashed
as a tuple. Two texts agree in an entry when the same k-mers are picked in the same
order, so moved passages count, unlike in plain MinHash.
"""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgate.llm.common import text_rows

# Production parameters: bytes of a k-mer, k-mers in a tuple, hash functions.
KMER, PICKED, SKETCHES = 8, 2, 32

# Positions hashed at a time, which bounds the memory for long texts.
STEP = 1 << 12

# Documents of a range at most, about, where rows in order of their ids are compared.
RANGE_ROWS = 1_000_000

_MIX = np.uint64(0xBF58476D1CE4E5B9)  # odd constants spread over 64 bits
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _GOLD
    return x ^ (x >> np.uint64(31))


_FACTORS = _mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)


def numbered_kmers(text: bytes) -> np.ndarray:
    """A 64-bit value per position: its k-mer and how many equal ones precede it.

    A text shorter than a k-mer is one k-mer, filled up with zero bytes; the empty
    text has none.
    """
    if not text:
        return np.zeros(0, np.uint64)
    data = text if len(text) >= KMER else text.ljust(KMER, b"\0")
    n = len(data) - KMER + 1
    kmers = np.ndarray((n,), "<u8", buffer=data, strides=(1,))
    base = _mixed(kmers.astype(np.uint64))
    order = np.argsort(base, kind="stable")
    ranked = base[order]
    new = np.ones(n, bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    if new.all():
        return base
    starts = np.flatnonzero(new)
    nth = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    number = np.empty(n, np.uint64)
    number[order] = nth
    return np.where(number > 0, _mixed(base + number * _GOLD), base)


def sketch(text: bytes) -> np.ndarray:
    """``SKETCHES`` tuple hashes; of a text with fewer k-mers than a tuple, all are taken.

    The sketch of the empty text is all zeros.
    """
    values = numbered_kmers(text)
    n = len(values)
    if not n:
        return np.zeros(SKETCHES, np.uint64)
    picked = min(PICKED, n)
    best = place = None
    rows = np.arange(SKETCHES)
    for at in range(0, n, STEP):
        part = values[at : at + STEP]
        spread = part ^ (part >> np.uint64(33))
        hashed = _FACTORS[:, None] * spread[None, :]
        own = np.empty((SKETCHES, min(picked, len(part))), np.int64)
        for i in range(own.shape[1]):
            own[:, i] = hashed.argmin(axis=1)
            hashed[rows, own[:, i]] = np.uint64(2**64 - 1)
        least = _FACTORS[:, None] * spread[own]
        if best is None:
            best, place = least, own + at
        else:
            best = np.concatenate([best, least], axis=1)
            place = np.concatenate([place, own + at], axis=1)
            keep = np.argsort(best, axis=1, kind="stable")[:, :picked]
            best = np.take_along_axis(best, keep, axis=1)
            place = np.take_along_axis(place, keep, axis=1)
    place.sort(axis=1)
    out = np.full(SKETCHES, _GOLD)
    for i in range(place.shape[1]):
        out = _mixed(out * _MIX + values[place[:, i]])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of entries in which two sketches agree."""
    return float((a == b).mean())


def fingerprint(s: np.ndarray) -> str:
    """A sketch as hexadecimal digits, 16 for each entry."""
    return s.astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` of every row; null texts are empty."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([fingerprint(sketch(t)) for t in texts], pa.string())],
                ["doc_id", "fingerprint"],
            )

    rows = text_rows(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first characters of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def in_ranges(docs: DataFrame) -> DataFrame:
    """``(range, head, doc_id, text)``: documents in ranges of descending id, with next heads.

    There are four ranges per shuffle partition, or as many as ``RANGE_ROWS`` asks for, cut
    at the quantiles of the ids. An id that fills several, or the rows without one, are cut
    on by a hash of the text. The first document of a range appears once more, marked
    ``head``, in the range before it (the very first one in the last), so that every
    document finds its successor in its own range. Texts move in one shuffle. One id per
    range reaches the driver.
    """
    texts = text_rows(docs)
    rows, known = texts.agg(F.count("*"), F.count("doc_id")).head()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = max(4 * partitions, -(-rows // RANGE_ROWS))
    shares = [i / number for i in range(1, number)]
    found = texts.agg(F.percentile_approx("doc_id", shares, 10 * number)).head()[0]
    times = Counter(found or [])
    cuts = sorted(times, reverse=True)
    ranged = texts.withColumn("range", _range(cuts, [times[c] for c in cuts], rows - known, rows, number))
    firsts = ranged.groupBy("range").agg(
        F.max(F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))).alias("first")
    ).collect()
    present = sorted((r["range"], r["first"]["doc_id"], r["first"]["h"]) for r in firsts)
    schema = "of long, first_id long, first_hash long, before long"
    heads = docs.sparkSession.createDataFrame(
        [(r, i, h, present[k - 1][0]) for k, (r, i, h) in enumerate(present)], schema
    )
    marked = ranged.join(F.broadcast(heads), F.col("range") == F.col("of"))
    is_head = (F.xxhash64("text") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    twice = F.when(is_head, F.array(
        F.struct(F.col("range").alias("range"), F.lit(False).alias("head")),
        F.struct(F.col("before").alias("range"), F.lit(True).alias("head")),
    )).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("head"))))
    both = marked.select(F.explode(twice).alias("p"), "doc_id", "text")
    return both.select("p.*", "doc_id", "text")


def _range(cuts, times, nulls, rows, number):
    """A row's range: how many cuts lie above its id, then the part of an id that has several.

    The parts of an id follow the other ids of its range, by falling hash of the text.
    """
    at = _cuts_above(cuts)
    parts = F.when(F.col("doc_id").isNull(), max(1, nulls * number // max(rows, 1)))
    if cuts:
        own = F.get(F.array(*[F.lit(c) for c in cuts]), at) == F.col("doc_id")
        parts = parts.when(own, F.get(F.array(*[F.lit(n) for n in times]), at))
    # Falling hashes, as signed numbers, become rising ones of 31 bits.
    hashed = F.bitwise_not(F.xxhash64("text").bitwiseXOR(F.lit(-(1 << 63))))
    rising = F.shiftrightunsigned(hashed, 33)
    part = F.when(parts > 1, 1 + F.shiftright(rising * parts, 31)).otherwise(0)
    return at.cast("long") * (1 << 31) + part


def _cuts_above(cuts):
    """How many of the descending ``cuts`` lie above ``doc_id``, by binary search; all
    for a null id."""
    if not cuts:
        return F.lit(0)
    known = F.array(*[F.lit(c) for c in cuts])

    def halve(s, _):
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        above = F.get(known, middle) > F.col("doc_id")
        return F.when(s["lo"] >= s["hi"], s).when(
            above, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))
        ).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    steps = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(
        F.aggregate(steps, start, halve, lambda s: s["lo"])
    )


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and what they have in common.

    The edit replaces the last third of a text by the beginning of the next document's,
    in descending order of ``doc_id``; after the last comes the first, and a single
    document follows itself. Rows without an id come last; rows of one id are ordered
    by a hash of their texts, and of equal rows each is followed by the next. An empty
    table gives no rows. Texts count whole, however long; other columns are not read.
    """
    ranged = in_ranges(docs)
    kind = ranged.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held = None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("range", "head", "doc_id", "text")]
            for at, head, doc_id, text in zip(*columns):
                own = None if head else sketch(text.encode())
                if held is not None and held[0] == at:
                    _, held_id, held_text, held_sketch = held
                    if own is None:
                        own = sketch(text.encode())
                    out.append(_reported(held_id, held_text, held_sketch, text, own))
                held = None if head else (at, doc_id, text, own)
            columns = list(zip(*out)) or [[]] * 7
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(),
                     pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], COLUMNS
            )

    dealt = ranged.repartition("range").sortWithinPartitions(
        "range", "head", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()
    )
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, " \
             "edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
           "near_edited", "near_next"]


def _reported(doc_id, text, own, following, next_sketch):
    changed = edited(text, following).encode()
    other = sketch(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed).hexdigest(), fingerprint(own),
        fingerprint(other), likeness(own, other), likeness(own, next_sketch),
    )
