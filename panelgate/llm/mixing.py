"""Mixing of sources to target weights by weighted fair queueing.

Each source's documents are shuffled and served in turn; a document's virtual
finish time is the number of its source's tokens up to and with it, divided by the
source's target. In the order of finish times all sources progress in proportion
to their targets, and the mix is the prefix that the total budget pays for.
"""

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgate.llm.common import WORD, free_name, materialize
from panelgate.operators.ordering import with_position

# Production parameters: weights in turn, budget and a source's limit in multiples of sizes.
WEIGHTS, BUDGET, REPEATS = (3, 1, 2), 1.5, 2

# Rows that share a bucket of the shuffled order, on average.
BUCKET_ROWS = 4096


def word_count(text="text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """``(source, source_size, weight, target)`` of a table ``(source, source_size)``.

    Sources take the weights in turn, in code point order, null last. A target is
    the smaller of ``level * weight`` and ``REPEATS`` times the size; the level is
    raised until the targets share the whole budget.
    """
    placed = with_position(sizes, F.col("source").asc_nulls_last(), name="place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = materialize(
        placed.select(
            "source", "source_size",
            F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * REPEATS).cast("double").alias("limit"),
        ),
        "sources",
    )
    level, whole = 0.0, None
    while True:
        full = F.col("limit") <= F.lit(level) * F.col("weight")
        row = weighted.agg(
            F.sum("source_size"),
            F.sum(F.when(full, F.col("limit")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).head()
        whole = budget * (row[0] or 0)
        raised = (whole - row[1]) / row[2] if row[2] else level
        if raised <= level:
            break
        level = raised
    return weighted.select(
        "source", "source_size", "weight",
        F.least("limit", F.lit(level) * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, size=None, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET,
        seed: int = 0) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source, source_size, target, copies, turn, finish``.

    ``copies`` says how often the mix takes the row, 0 to ``REPEATS``; ``turn`` is its
    place in the shuffle, ``finish`` its first virtual finish time. Rows that are equal
    in id, text and source have one turn and are treated alike. Rows of size 0 take no
    budget and are never taken. A null source is a source of its own, null ids are
    shuffled by their texts, an empty table gives none. Texts count whole, however long;
    equal finish times go by source and turn. Columns other than ``doc_id``, ``text``
    and ``source`` are not read, whatever their names. Reruns agree.
    """
    sized = materialize(
        docs.select(
            F.col("doc_id"), F.col("source"), turn_of(seed),
            (word_count() if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"),
        ),
        "sizes",
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(by_source, weights, budget).withColumnRenamed("source", "of")
    n = sized.count()
    parts = max(1, n // BUCKET_ROWS)
    # The upper half of the hash as a fraction of 2^32, cut in equal ranges.
    bucket = F.floor((F.shiftright("turn", 32) + F.lit(1 << 31)) * parts / (1 << 32))
    rows = sized.join(aims, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("bucket", bucket)
    within = Window.partitionBy("source", "bucket").orderBy("turn")
    bases = _bases(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), parts)
    served = rows.withColumn("within", F.sum("size").over(within)).join(
        bases, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))
    )
    served = materialize(
        served.select(
            "doc_id", "size", "source", "source_size", "target", "turn",
            (F.col("base") + F.col("within")).alias("up_to"),
        ),
        "served",
    )
    cut = _cut(served, parts)
    taken = F.lit(0)
    for nth in range(REPEATS):
        taken = taken + F.when(F.col("size") > 0, (_place(nth) <= cut).cast("int")).otherwise(0)
    return served.select(
        "doc_id", "size", "source", "source_size", "target",
        F.coalesce(taken, F.lit(0)).alias("copies"), "turn", _finish(0).alias("finish"),
    )


def _bases(sums, parts):
    """``(of, at, base)``: the sizes before every bucket of a source.

    Neighbouring buckets are summed in groups and the groups in their source, each about
    the square root of all, so no task holds all buckets of a source.
    """
    width = math.isqrt(parts) + 1
    sums = materialize(sums.withColumn("group", F.floor(F.col("bucket") / width)), "bucket-sums")
    first = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("source", "group").orderBy("bucket").rowsBetween(*first)
    groups = sums.groupBy("source", "group").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("group").rowsBetween(*first)
    starts = groups.select(
        F.col("source").alias("s"), F.col("group").alias("g"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"),
    )
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g"))
    within = sums.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return within.join(starts, same).select(
        F.col("source").alias("of"), F.col("bucket").alias("at"),
        (F.col("start") + F.col("inside")).alias("base"),
    )


def turn_of(seed: int = 0):
    return F.xxhash64(F.lit(seed), "doc_id", "text", "source").alias("turn")


def _finish(nth):
    tokens = F.col("up_to") + F.lit(nth) * F.col("source_size")
    return F.when(F.col("target") > 0, tokens / F.col("target"))


def _place(nth):
    """Place of the ``nth`` copy in the global order; source and turn break ties."""
    return F.struct(
        _finish(nth).alias("finish"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.lit(nth).alias("nth"),
        F.col("turn").alias("turn"),
    )


def _cut(served, parts):
    """Place of the last copy that the budget, the sum of the targets, pays for.

    Finish times are ranged into equal buckets up to virtual time 2, twice the time
    the whole mix takes. Sums over groups of buckets, then over the buckets of one group,
    find the one where the budget ends; only this one is sorted by row. The driver sees
    about twice the square root of the number of buckets.
    """
    copies = served.select(
        "size", F.explode(F.array(*[_place(nth) for nth in range(REPEATS)])).alias("place")
    ).filter((F.col("place.finish") <= 2) & (F.col("size") > 0))
    ranged = copies.withColumn("range", F.floor(F.col("place.finish") * parts))
    budget = served.select("source", "target").distinct().agg(F.sum("target")).head()[0] or 0.0
    # Doubles that are sums of targets may lie a hair below the whole number they stand for.
    limit = budget + 1e-6
    crossing = _crossing(ranged.groupBy("range").agg(F.sum("size").alias("n")), parts, limit)
    if crossing is None:
        last = ranged.agg(F.max("place")).head()[0]
    else:
        inside = ranged.filter(F.col("range") == crossing[0]).withColumn(
            "total", F.sum("size").over(Window.partitionBy("range").orderBy("place"))
        )
        last = inside.filter(F.col("total") + crossing[1] <= limit).agg(F.max("place")).head()[0]
        if last is None:
            last = ranged.filter(F.col("range") < crossing[0]).agg(F.max("place")).head()[0]
    if last is None:
        return F.struct(F.lit(-1.0).alias("finish"), F.lit("").alias("source"),
                        F.lit(0).alias("nth"), F.lit(0).cast("long").alias("turn"))
    return F.struct(
        F.lit(last["finish"]).alias("finish"), F.lit(last["source"]).alias("source"),
        F.lit(last["nth"]).alias("nth"), F.lit(last["turn"]).cast("long").alias("turn"),
    )


def _crossing(sums, parts, limit):
    """The bucket in which the running sum passes ``limit``, and the sum before it."""
    width = math.isqrt(2 * parts) + 1
    group = F.floor(F.col("range") / width)
    sums = materialize(sums, "range-sums")
    before, found = 0, None
    for rows in (
        lambda: sums.groupBy(group.alias("at")).agg(F.sum("n").alias("n")),
        lambda: sums.filter(group == found).select(F.col("range").alias("at"), "n"),
    ):
        # About ``width`` groups, then at most ``width`` buckets of one.
        for at, n in sorted(rows().collect()):
            if before + n > limit:
                found = at
                break
            before += n
        else:
            return None
    return found, before


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them, unordered.

    Other columns pass untouched, whatever their names.
    """
    turn, copies = free_name(docs, "turn"), free_name(docs, "copies")
    counted = mix(docs, **options).filter("copies > 0").groupBy("turn").agg(
        F.max("copies").alias(copies)
    ).withColumnRenamed("turn", turn)
    # What is taken grows with the documents: the same join at every size.
    turned = docs.withColumn(turn, turn_of(options.get("seed", 0)))
    joined = turned.join(counted.hint("merge"), turn)
    repeated = joined.select(
        *[F.col(c) for c in docs.columns],
        F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies),
    )
    return repeated.drop(copies)
