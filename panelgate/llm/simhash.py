"""SimHash near-duplicates of whole documents.

A fingerprint has a bit set where more than half of the hashes of the document's
word shingles have it; documents link when their fingerprints differ in at most
``RADIUS`` bits. Distinct fingerprints are dealt into buckets that agree on some
blocks of bits: of five blocks, four changed bits leave one untouched, so every
link lies in a bucket. Inside a bucket the bits are stored as vertical planes and
the distances of many pairs are counted at once by carry-save counters.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgate.llm.common import free_name, materialize, star_components, text_rows

# Fixed values of the fingerprint.
SHINGLE, SEED, RADIUS = 4, 42, 4

# A bucket above this size is dealt out again on further bits instead of compared.
BUCKET = 4096


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of UTF-8 text as a signed integer; without words it is 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    last = ends[SHINGLE - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, 1 << 16):
        some = zip(starts[at : at + (1 << 16)], last[at : at + (1 << 16)])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in some], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, key)`` of every row; null and empty texts have fingerprint 0.

    ``key`` is a hash of the text that tells rows of one id apart.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = pa.array([fingerprint(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), fps, batch.column("key")], ["doc_id", "fp", "key"]
            )

    rows = text_rows(docs, F.xxhash64("text").alias("key"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long, key long")


def block_count(n: int) -> int:
    """Blocks that keep an evenly filled bucket at 256 fingerprints or fewer."""
    for blocks in range(RADIUS + 1, 10):
        if n >> (64 * (blocks - RADIUS) // blocks) <= 256:
            break
    return blocks


def masks(blocks: int, bits: list[int] | None = None) -> list[int]:
    """One mask for every choice of ``blocks - RADIUS`` blocks of the given bits."""
    bits = list(range(64)) if bits is None else bits
    cuts = [len(bits) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - RADIUS)]


def _finer(mask):
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | more for more in masks(6, free)]


def links(fps: DataFrame, blocks: int) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the fingerprints within the radius.

    ``fps`` holds distinct values ``fp``. From a bucket come only the edges of a
    tree for each connected part. A bucket above ``BUCKET`` members is dealt out
    again on further bits: within it at most four of the free bits differ, so of
    six blocks of these two agree. Once twelve bits are free a bucket has no more than
    ``BUCKET`` = 2^12 values, so the rounds end whatever the data.
    """
    tables = np.array(masks(blocks), np.uint64)

    def first(batches):
        for batch in batches:
            yield _dealt(np.asarray(batch.column("fp")).view(np.uint64), tables)

    def again(batches):
        for batch in batches:
            fp = np.asarray(batch.column("a")).view(np.uint64)
            of = np.asarray(batch.column("mask")).view(np.uint64)
            for mask in np.unique(of):
                yield _dealt(fp[of == mask], np.array(_finer(int(mask)), np.uint64))

    found, todo, deal = [], fps, first
    while True:
        dealt = todo.mapInArrow(deal, "mask long, key long, fp long")
        in_buckets = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        out = materialize(in_buckets.mapInArrow(_compared, "a long, b long, mask long"), "links")
        found.append(out.filter("mask is null").select("a", "b"))
        todo, deal = out.filter("mask is not null"), again
        if todo.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every


def _dealt(fp, tables):
    mask = np.repeat(tables, len(fp))
    key = (tables[:, None] & fp[None, :]).ravel()
    return pa.RecordBatch.from_arrays(
        [pa.array(x.view(np.int64)) for x in (mask, key, np.tile(fp, len(tables)))],
        ["mask", "key", "fp"],
    )


def _rows(a, b, mask):
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(mask, pa.int64())],
        ["a", "b", "mask"],
    )


def _compared(batches):
    """Links of each bucket of the sorted rows; members of too large ones with their mask."""
    held, held_key, passed, before = [], None, False, None
    for batch in batches:
        mask, key, fp = (np.asarray(batch.column(c)) for c in ("mask", "key", "fp"))
        if not len(fp):
            continue
        # Two coarser masks may have been refined to one: its members then come twice.
        new = np.ones(len(fp), bool)
        new[1:] = (np.diff(mask) != 0) | (np.diff(key) != 0) | (np.diff(fp) != 0)
        new[0] = before != (mask[0], key[0], fp[0])
        before = (mask[-1], key[-1], fp[-1])
        if not new.any():
            continue
        mask, key, fp = mask[new], key[new], fp[new]
        cut = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
        bounds = [0, *cut.tolist(), len(fp)]
        a, b = [], []
        for i, j in zip(bounds, bounds[1:]):
            at = (int(mask[i]), int(key[i]))
            if at != held_key:
                _close(held, held_key, passed, a, b)
                held, held_key, passed = [], at, False
            held.append(fp[i:j])
            if passed or sum(map(len, held)) > BUCKET:
                members = np.concatenate(held)
                yield _rows(members, np.zeros(len(members), np.int64), np.full(len(members), at[0]))
                held, passed = [], True
        if a:
            yield _rows(np.concatenate(a), np.concatenate(b), [None] * sum(map(len, a)))
    a, b = [], []
    _close(held, held_key, passed, a, b)
    if a:
        yield _rows(np.concatenate(a), np.concatenate(b), [None] * sum(map(len, a)))


def _close(held, key, passed, a, b):
    if passed or not held or sum(map(len, held)) < 2:
        return
    members = np.concatenate(held)
    tree = bucket_links(members.view(np.uint64), key[0] & (2**64 - 1))
    if len(tree):
        a.append(members[tree[:, 0]])
        b.append(members[tree[:, 1]])


def near(fps: np.ndarray, equal: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Members that have others within the radius, and these as rows of bits.

    Plane ``b`` holds bit ``b`` of 64 members in each word. For all members at once
    the planes are compared with the member's own bit and added to three carry-save
    counters and an overflow word. Members whose whole row is past the radius are
    left out of the following planes. ``equal`` masks bits that all members share.
    """
    n = len(fps)
    width = -(-n // 64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, width * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    alive = np.arange(n)
    # Places past the end and the member itself start as too far.
    far = np.zeros((n, width * 64), np.uint8)
    far[:, n:] = 1
    far[alive, alive] = 1
    over = np.packbits(far, axis=1, bitorder="little").view(np.uint64)
    one, two, four = (np.zeros((n, width), np.uint64) for _ in range(3))
    own = np.where(bits.astype(bool), np.uint64(2**64 - 1), np.uint64(0))
    free = [b for b in range(64) if not equal >> b & 1]
    open_ = ~over
    for done, b in enumerate(free, 1):
        carry = planes[b] ^ own[alive, b][:, None]
        one, carry = one ^ carry, one & carry
        two, carry = two ^ carry, two & carry
        four, carry = four ^ carry, four & carry
        over |= carry
        if done % 8 == 0 or done == len(free):
            # A count of four at most: the highest counter is clear or stands alone.
            open_ = ~(over | (four & (one | two)))
            rows = open_.any(axis=1)
            if not rows.all():
                alive, one, two, four, over = (x[rows] for x in (alive, one, two, four, over))
                open_ = open_[rows]
            if not len(alive):
                return alive, np.zeros((0, width), np.uint64)
    return alive, open_


def bucket_links(fps: np.ndarray, equal: int = 0) -> np.ndarray:
    """Edges (positions) of a spanning forest of the links among distinct fingerprints."""
    alive, rows = near(fps, equal)
    row_of = {int(m): i for i, m in enumerate(alive)}
    width = rows.shape[1]
    unseen = np.full(width, 2**64 - 1, np.uint64)
    edges = []
    for start in row_of:
        if not unseen[start >> 6] >> np.uint64(start & 63) & np.uint64(1):
            continue
        unseen[start >> 6] &= ~(np.uint64(1) << np.uint64(start & 63))
        todo = [start]
        while todo:
            new = rows[row_of[todo.pop()]] & unseen
            unseen &= ~new
            reached = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
            todo.extend(reached.tolist())
            edges.extend((start, m) for m in reached.tolist())
    return np.array(edges, np.int64).reshape(-1, 2)


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, key, root, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links reach, ``root`` the smallest
    fingerprint of the component. Rows without an id take part and name a component
    only by null, where it has no other rows. Repeated rows are repeated in the result;
    an empty table gives none. Texts count whole, however long; columns other than
    ``doc_id`` and ``text`` are not read, whatever their names.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    firsts = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    stars = star_components(links(firsts.select("fp"), block_count(firsts.count())))
    rooted = firsts.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "root", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "key", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those near an earlier one: one row of each component stays.

    It is the row with the component's smallest id, rows without an id coming last; of
    several rows with this id the one with the smallest text hash, and one of equal rows.
    Other columns pass untouched, whatever their names.
    """
    ids = components(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r")
    of, of_key = free_name(docs, "of"), free_name(docs, "of_key")
    single = materialize(
        ids.groupBy("root").agg(least).select("r.doc_id", "r.key").withColumnsRenamed(
            {"doc_id": of, "key": of_key}
        ),
        "kept",
    )
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.col("key") == F.col(of_key))
    kept = ids.select("doc_id", "key").join(single, same, "left_semi").count()
    this = F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(of_key))
    # The list grows with the documents: the same join at every size, never a broadcast.
    left = docs.join(single.hint("merge"), this, "left_semi")
    if kept == single.count():
        return left
    # Only where kept rows repeat are whole rows gathered.
    return left.groupBy("doc_id", F.xxhash64("text")).agg(
        F.first(F.struct(*left.columns)).alias("row")
    ).select("row.*")
