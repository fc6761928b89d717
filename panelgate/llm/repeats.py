"""Removal of long byte strings that a corpus has seen before.

A sparse suffix array: of the suffixes only those at anchors are ranked, the places
where the smallest hash of ``GRAM`` bytes inside some window of ``LENGTH`` bytes
stands. Equal windows have their anchor at the same place, so no repeat is lost.
Ranks are equality classes that grow by prefix doubling: Spark sorts anchors by the
class of their gram and, behind it, of the text that all windows of the anchor cover;
what is unique is dropped, what is settled leaves. Only windows of grams that stand
in different surroundings are ranked one by one, from 8 bytes over 16, 32 and 64 to
``LENGTH``, each time from pairs of classes at a growing offset.

A gram that a task meets in ``SPREAD_FROM`` surroundings or more is dealt out by gram and
surroundings, with one row to its gram's own task that tells it is not alone there. The
places of a gram are then compared in shares of ``GROUP``, so no gram is one task's.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgate.llm.common import materialize

# Production parameter: bytes of a string that must not repeat.
LENGTH = 100

# Bytes of a gram; the windows of LENGTH bytes hold LENGTH - GRAM + 1 of them.
GRAM = 24

# Bytes of text whose anchors are gathered before they are combined, and anchors with one
# gram and different surroundings that one task compares; beyond it Spark ranks windows.
TEXT_BYTES, GROUP = 8 << 20, 2_000

# Surroundings of one gram in a task's gathered texts from which it is dealt out by them.
SPREAD_FROM = 32

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PLACES = 20  # low bits that hold a position while minima are sought


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _A
    return x ^ (x >> np.uint64(31))


def _eights(data: bytes) -> np.ndarray:
    """Class of the 8 bytes at every position that has so many."""
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    return _mixed(words.astype(np.uint64))


def _doubled(rank: np.ndarray, offset: int) -> np.ndarray:
    """Class of the pair of classes at each position and ``offset`` further on."""
    return _mixed(rank[: len(rank) - offset] * _A + rank[offset:])


def gram_ranks(data: bytes) -> np.ndarray:
    """Classes of ``GRAM`` bytes at every position."""
    rank, size = _eights(data), 8
    while size < GRAM:
        step = min(size, GRAM - size)
        rank, size = _doubled(rank, step), size + step
    return rank


def window_ranks(data: bytes, length: int) -> np.ndarray:
    """Classes of ``length`` bytes at every position, by prefix doubling."""
    rank, size = _eights(data), 8
    while size < length:
        step = min(size, length - size)
        rank, size = _doubled(rank, step), size + step
    return rank


def anchors(data: bytes, length: int = LENGTH):
    """``(gram class, first start, last start)`` of every anchor as three arrays.

    The windows that start from the first to the last start have this anchor: the
    leftmost of their smallest gram classes.
    """
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < length:
        return empty
    rank = gram_ranks(data)
    grams = length - GRAM + 1
    parts, span = [], (1 << _PLACES) - grams
    for at in range(0, len(rank) - grams + 1, span):
        part = rank[at : at + span + grams - 1]
        least = part >> np.uint64(_PLACES) << np.uint64(_PLACES)
        least |= np.arange(len(part), dtype=np.uint64)
        size = 1
        while size < grams:
            step = min(size, grams - size)
            least = np.minimum(least[: len(least) - step], least[step:])
            size += step
        parts.append((least & np.uint64((1 << _PLACES) - 1)).astype(np.int64) + at)
    place = np.concatenate(parts)
    first = np.flatnonzero(np.concatenate([[True], np.diff(place) != 0]))
    last = np.append(first[1:], len(place)) - 1
    return rank[place[first]], first, last, place[first]


def _surroundings(data, first, last, place, length):
    """Class of the text that an anchor's windows cover and of the anchor's place in it."""
    digest = xxhash.xxh3_64_intdigest
    cuts = zip(first.tolist(), (last + length).tolist(), (place - first).tolist())
    return np.fromiter((digest(data[i:j], at) for i, j, at in cuts), np.uint64, len(first))


ANCHORS = "gram long, around long, doc long, first int, last int, state int"
RANKED = ANCHORS + ", share long"
# A repeat; word of a gram that is dealt out; a place that may repeat; one of a gram dealt out.
SETTLED, SEVERAL, OPEN, SPREAD = 0, 1, 2, 3


def _anchor_batch(gram, around, doc, first, last, state, share=None):
    columns = [
        (gram, "gram", pa.int64()), (around, "around", pa.int64()), (doc, "doc", pa.int64()),
        (first, "first", pa.int32()), (last, "last", pa.int32()), (state, "state", pa.int32()),
    ]
    if share is not None:
        columns.append((share, "share", pa.int64()))
    arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, kind) for x, _, kind in columns]
    return pa.RecordBatch.from_arrays(arrays, [name for _, name, _ in columns])


def _find_anchors(length):
    def flush(held):
        gram, around, doc, first, last = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((first, doc, around, gram))
        gram, around, doc, first, last = (x[order] for x in (gram, around, doc, first, last))
        again = np.zeros(len(gram), bool)
        again[1:] = (gram[1:] == gram[:-1]) & (around[1:] == around[:-1])
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        size = np.diff(np.append(starts, len(gram)))
        many = np.add.reduceat((~again).astype(np.int64), starts) >= SPREAD_FROM
        state = np.where(again, SETTLED, np.where(np.repeat(many, size), SPREAD, OPEN))
        word = gram[starts[many]]
        # Repeats that this task has seen itself are settled; they are dealt out by place.
        gram = np.where(again, _mixed(around + doc.astype(np.uint64) * _A + first.astype(np.uint64)), gram)
        none = np.zeros(len(word), np.int64)
        return _anchor_batch(*(np.concatenate(x) for x in (
            (gram, word), (around, none.astype(np.uint64)), (doc, none), (first, none), (last, none),
            (state, none + SEVERAL))))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for doc, text in zip(batch.column("doc").to_pylist(), texts):
                data = text.as_py()
                if len(data) < length:
                    continue
                gram, first, last, place = anchors(data, length)
                around = _surroundings(data, first, last, place, length)
                held.append((gram, around, np.full(len(gram), doc, np.int64), first, last))
                size += len(data)
                if size >= TEXT_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _rank_anchors(batches):
    """Settles repeated surroundings in rows sorted by gram, state, surroundings and place.

    Of rows with one gram and one surrounding the first stays open, the others are
    settled repeats. A gram with a single open row is unique and dropped, unless it is
    dealt out. Open rows get their share: the number of ``GROUP`` rows of the gram before
    them, from 1 where other tasks hold more of the gram. What the last rows of a batch
    need is carried over: at most one row.
    """
    task = TaskContext.get().partitionId()
    key0 = around0 = waiting = None
    opened0, sure0 = 0, False
    for batch in batches:
        fields = [np.asarray(c) for c in batch.columns]
        known = fields[-1] == SETTLED
        if known.any():
            yield _anchor_batch(*(x[known] for x in fields), np.zeros(known.sum(), np.int64))
            fields = [x[~known] for x in fields]
        gram, around, doc, first, last, state = fields
        n = len(gram)
        if not n:
            continue
        word, spread = state == SEVERAL, state == SPREAD
        new_gram, new_around = np.ones(n, bool), np.ones(n, bool)
        new_gram[1:] = (gram[1:] != gram[:-1]) | (spread[1:] != spread[:-1])
        new_around[1:] = new_gram[1:] | word[:-1] | (around[1:] != around[:-1])
        if key0 is not None:
            new_gram[0] = (gram[0], spread[0]) != key0
            new_around[0] = new_gram[0] or around0 is None or around[0] != around0
        new_around &= ~word
        starts = np.flatnonzero(new_gram)
        if not len(starts) or starts[0]:
            starts = np.concatenate([[0], starts])
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        opened = np.add.reduceat(new_around.astype(np.int64), starts)
        sure = np.logical_or.reduceat(word | spread, starts)
        before = np.zeros(len(starts), np.int64)
        if new_gram[0]:
            waiting = None
        else:
            before[0] = opened0
            sure[0] |= sure0
        several = sure | (before + opened > 1)
        out = []
        if several[0] and waiting is not None:
            out.append(waiting)
            waiting = None
        nth = np.cumsum(new_around) - 1 + (before - np.cumsum(opened) + opened)[run]
        share = np.maximum(nth, 0) // GROUP + sure[run] + np.where(spread, task << 32, 0)
        rows = (gram, around, doc, first, last, np.where(new_around, OPEN, SETTLED), share)
        emit = ~word & (several[run] | ~new_around)
        out.append(tuple(x[emit] for x in rows))
        if several[-1]:
            waiting = None
        elif opened[-1]:
            i = starts[-1] + int(new_around[starts[-1] :].argmax())
            waiting = tuple(x[i : i + 1] for x in rows)
        key0, around0 = (gram[-1], spread[-1]), None if word[-1] else around[-1]
        opened0, sure0 = before[-1] + opened[-1], sure[-1]
        yield _anchor_batch(*(np.concatenate(x) for x in zip(*out)))


def _texts_around(length):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            docs, found = batch.column("doc").to_pylist(), batch.column("found").to_pylist()
            rows = []
            for doc, text, wanted in zip(docs, texts, found):
                data = text.as_py()
                rows += [
                    (w["gram"], w["share"], doc, w["first"], data[w["first"] : w["last"] + length])
                    for w in wanted
                ]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["gram", "share", "doc", "first", "around"],
            )

    return run


def _windows(rows, length):
    """Gram, class, document and start of every window of the given surroundings."""
    texts = [r[3] for r in rows]
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = sizes - length + 1
    ends = np.cumsum(sizes)
    rank = window_ranks(b"".join(texts), length)
    of = np.repeat(np.arange(len(rows)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    rank = rank[(ends - sizes)[of] + within]
    gram, doc, first = (np.array([r[i] for r in rows], np.int64)[of] for i in range(3))
    return gram, rank.view(np.int64), doc, first + within


def _window_batch(doc, start, stop, gram=None, rank=None):
    n = len(doc)
    nothing = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()),
         nothing if gram is None else pa.array(gram, pa.int64()),
         nothing if rank is None else pa.array(rank, pa.int64())],
        ["doc", "start", "stop", "gram", "rank"],
    )


def _ranked_windows(rows, length):
    """Windows of the given surroundings in rank order, and which of them stand earlier too."""
    gram, rank, doc, start = _windows(rows, length)
    order = np.lexsort((start, doc, rank, gram))
    gram, rank, doc, start = (x[order] for x in (gram, rank, doc, start))
    again = np.zeros(len(gram), bool)
    again[1:] = (gram[1:] == gram[:-1]) & (rank[1:] == rank[:-1])
    return gram, rank, doc, start, again


def _runs(doc, start):
    """Neighbouring starts of one document as runs."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    stop = start[np.append(at[1:], len(doc)) - 1] if len(doc) else start
    return _window_batch(doc[at], start[at], stop)


def _repeated_windows(rows, length):
    """Runs of starts whose windows stand earlier too, among the surroundings of some grams."""
    _, _, doc, start, again = _ranked_windows(rows, length)
    return _runs(doc[again], start[again])


def _compare(length):
    """Groups of one gram, many at a time; windows of too large ones, whose share is full or
    not the only one, are passed on."""

    def run(batches):
        held, group, key0, passed = [], [], None, False
        size = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gram", "doc", "first", "around")]
            for share, row in zip(batch.column("share").to_pylist(), zip(*columns)):
                if (row[0], share) != key0:
                    if not passed:
                        held += group
                        size += len(group)
                    elif group:
                        yield from _passed(group, length)
                    if size >= GROUP:
                        yield _repeated_windows(held, length)
                        held, size = [], 0
                    group, key0, passed = [], (row[0], share), share > 0
                group.append(row)
                if len(group) >= GROUP:
                    yield from _passed(group, length)
                    group, passed = [], True
        if passed and group:
            yield from _passed(group, length)
        elif not passed:
            held += group
        if held:
            yield _repeated_windows(held, length)

    return run


def _passed(group, length):
    """A piece of a large group: what repeats inside it is settled, the rest is passed on."""
    gram, rank, doc, start, again = _ranked_windows(group, length)
    yield _runs(doc[again], start[again])
    open_ = ~again
    yield _window_batch(doc[open_], start[open_], start[open_], gram[open_], rank[open_])


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``(doc, text)``, and whether ``doc`` is the id itself.

    Where ids are missing or repeated, rows are numbered by id (none first), then by
    a hash of the text; rows equal in both are one document.
    """
    from panelgate.operators.ordering import with_position

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.groupBy("doc_id").agg(F.count("*").alias("n"))
    bad = counted.agg(F.max("n"), F.count_if(F.col("doc_id").isNull())).head()
    if (bad[0] or 0) <= 1 and not bad[1]:
        return texts.select(F.col("doc_id").cast("long").alias("doc"), "text"), True
    keyed = texts.withColumn("hash", F.xxhash64("text"))
    order = with_position(
        keyed.select("doc_id", "hash").distinct(), F.col("doc_id").asc_nulls_first(), "hash", name="doc"
    ).withColumnsRenamed({"doc_id": "of", "hash": "of_hash"})
    joined = keyed.join(order, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")))
    return materialize(joined.select("doc_id", "doc", "text"), "numbered"), False


def strip_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """Every document without the bytes of ``length``-byte strings that start earlier too.

    Earlier is a smaller ``doc_id`` or an earlier start in the document. Strings are
    judged on the input and may overlap, also with their own repeat; they never cross
    documents. Columns: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, with
    ``texts`` also the remaining bytes ``kept``. Null and empty texts have no bytes.
    Rows without an id come before all others, rows of one id follow the hash of their
    texts, equal rows are one document and each get its result. Texts count whole, however
    long; an empty table gives no rows, and other columns are not read, whatever their names.
    """
    numbered, plain = _numbered(docs)
    found = numbered.select("doc", "text").mapInArrow(_find_anchors(length), ANCHORS)
    by = F.when(F.col("state") == SPREAD, F.xxhash64("gram", "around")).otherwise(F.col("gram"))
    ranked = found.repartition(by).sortWithinPartitions("gram", "state", "around", "doc", "first")
    repeats = materialize(
        ranked.mapInArrow(_rank_anchors, RANKED).select(
            F.when(F.col("state") == OPEN, F.col("gram")).alias("gram"),
            "doc", "first", "last", "state", "share",
        ),
        "repeats",
    )
    whole = repeats.filter(F.col("state") == SETTLED).select(
        "doc", F.col("first").cast("long").alias("start"), F.col("last").cast("long").alias("stop")
    )
    # Both joins below read one shuffle of the texts.
    stored = numbered.filter("doc is not null")
    wanted = repeats.filter(F.col("state") == OPEN).groupBy("doc").agg(
        F.collect_list(F.struct("gram", "share", "first", "last")).alias("found")
    )
    around = stored.select("doc", "text").join(wanted, "doc").mapInArrow(
        _texts_around(length), "gram long, share long, doc long, first int, around binary"
    )
    grouped = around.repartition("gram", "share").sortWithinPartitions("gram", "share", "doc", "first")
    compared = grouped.mapInArrow(
        _compare(length), "doc long, start long, stop long, gram long, rank long"
    )
    runs = compared.filter("gram is null").select("doc", "start", "stop")
    windows = compared.filter("gram is not null")
    firsts = windows.groupBy("gram", "rank").agg(
        F.min(F.struct("doc", "start")).alias("earliest"), F.count("*").alias("n")
    ).filter("n > 1")
    later = windows.join(firsts, ["gram", "rank"]).filter(
        F.struct("doc", "start") != F.col("earliest")
    ).select("doc", "start", "stop")
    intervals = whole.union(runs).union(later)
    lists = intervals.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    extra = [] if plain else ["doc_id"]
    joined = stored.select("doc", *extra, "text").join(lists, "doc", "left")
    if plain:
        joined = joined.withColumnRenamed("doc", "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" if texts else ""
    return joined.select(F.col("doc_id").cast(kind).alias("doc_id"), "text", "found").mapInArrow(
        _stripped(length, texts), schema
    )


def cut(data: bytes, runs: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """``data`` without the windows that start in the runs, bytes and spans removed."""
    kept, at, spans, reach = [], 0, 0, -1
    for start, stop in sorted(runs):
        if start > reach:
            kept.append(data[at:start] if reach < 0 else data[reach:start])
            spans += 1
        reach = max(reach, stop + length)
    kept.append(data[max(reach, 0) :])
    left = b"".join(kept)
    return left, len(data) - len(left), spans


def _stripped(length, texts):
    def run(batches):
        for batch in batches:
            rows, left = [], []
            for text, found in zip(batch.column("text").cast(pa.binary()), batch.column("found").to_pylist()):
                data = text.as_py()
                kept, removed, spans = cut(data, [(f["start"], f["stop"]) for f in found or []], length)
                rows.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
                left.append(kept)
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            arrays = [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                arrays.append(pa.array(left, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names + ["kept"] * texts)

    return run
