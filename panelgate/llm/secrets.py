"""Secret scan with multipart credentials, in DataFrame functions alone.

Base patterns always count. Weaker candidates (identifiers, random-looking strings,
endpoints) say little alone: they are reported only where a complementary part lies
within ``REACH`` characters of the same text, found by a join of intervals.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgate.llm.common import free_name, materialize

# Patterns of the base kinds, in the order in which equal starts are
# listed, with the least length of the part that counts (a group, or the match).
BASE = {
    "assign": (
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # Shorter runs fail and never overlap a longer one, so they need not be matched.
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}

# Weak kinds, each giving way to the ones before it where spans overlap.
WEAK = {
    "id": r"(?i)(?<![a-z0-9_])(?:user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?"
          r"|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}",
    "random": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])"
              r"(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{16,}",
    "endpoint": r"(?i)(?<![a-z0-9])(?:https?|ftp|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)"
                r"(?::[a-z]+)?://[^\x20\x09-\x0D\"'<>]{4,}",
}

KINDS = [*BASE, *WEAK]

# The part each kind plays, and the parts that make a weak candidate count.
ROLE = {
    "assign": "secret", "access": "id", "hex": "secret",
    "id": "id", "random": "secret", "endpoint": "endpoint",
}
NEEDS = {"id": ["secret"], "random": ["id", "endpoint"], "endpoint": ["secret"]}

# Production parameters: how far apart the parts of a credential may stand, in characters,
# and the width of the bins in which intervals are joined.
REACH, BIN = 200, 1000

MASK = "[SECRET]"


def _pattern(kind):
    return BASE[kind][0] if kind in BASE else WEAK[kind]


def _hits(kind: str, text: Column) -> Column:
    """Lengths of the gaps before the matches, of the matches and of what counts of them.

    The text between matches is what a split by the pattern leaves, so positions
    follow from lengths; no matched text is kept.
    """
    pattern = F.lit(_pattern(kind))
    group = BASE[kind][1] if kind in BASE else 0
    gaps = F.transform(F.split(text, _pattern(kind), -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), F.length)
    return F.when(
        F.regexp_like(text, pattern),
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("hit"),
                     counted.alias("counted")),
    )


def suspect(text="text") -> Column:
    """Whether any pattern matches: texts where none does have no spans."""
    found = [F.regexp_like(F.col(text), F.lit(_pattern(k))) for k in KINDS]
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False))


def _located(docs: DataFrame) -> DataFrame:
    """One row per text: ``row``, ``doc_id``, ``key`` and the matches of each kind.

    ``row`` numbers the rows; the table is written down, so it stays the same.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id"),
            key_of().alias("key"), *[_hits(k, text).alias(k) for k in KINDS],
        ),
        "matches",
    )


def key_of():
    return F.xxhash64("doc_id", "text")


def _parts(located: DataFrame) -> DataFrame:
    """``row, kind, start, end`` of every candidate; ``kind`` is a place in ``KINDS``."""
    kinds = F.array(*[
        F.struct(F.lit(i).alias("kind"), F.col(k).alias("hits")) for i, k in enumerate(KINDS)
    ])
    each = located.select("row", F.explode(kinds).alias("k")).filter("k.hits is not null")
    hits = each.select("row", "k.kind", F.posexplode("k.hits").alias("nth", "h"))
    up_to = Window.partitionBy("row", "kind").orderBy("nth")
    placed = hits.select(
        "row", "kind", F.col("h.counted").alias("counted"), F.col("h.hit").alias("hit"),
        F.sum((F.col("h.gap") + F.col("h.hit")).cast("long")).over(up_to).alias("end"),
    )
    least = F.element_at(F.array(*[F.lit(BASE[k][2] if k in BASE else 0) for k in KINDS]),
                         F.col("kind") + 1)
    return placed.filter(F.col("counted") >= least).select(
        "row", "kind", (F.col("end") - F.col("hit")).alias("start"), "end"
    )


def _near(left: DataFrame, right: DataFrame, reach: int, more: Column, how: str) -> DataFrame:
    """Rows of ``left`` with (or, ``left_anti``, without) an interval of ``right`` in reach.

    Both sides are spread over the bins they touch and joined on text and bin. A
    match is a property of the left row, so no pair is ever built.
    """
    bins = F.sequence(
        F.expr(f"(start - {reach}) div {BIN}"), F.expr(f"(`end` + {reach}) div {BIN}")
    )
    own = ["row", "kind", "start", "end"]
    spread = left.select(*own, F.explode(bins).alias("bin"))
    other = right.select(
        F.col("row").alias("o_row"), F.col("kind").alias("o_kind"),
        F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.explode(F.sequence(F.expr(f"start div {BIN}"), F.expr(f"`end` div {BIN}"))).alias("o_bin"),
    )
    touches = (
        (F.col("row") == F.col("o_row")) & (F.col("bin") == F.col("o_bin"))
        & (F.col("o_start") < F.col("end") + reach) & (F.col("start") - reach < F.col("o_end"))
    )
    matched = spread.join(other, touches & more, "left_semi").select(*own).distinct()
    return matched if how == "left_semi" else left.join(matched, own, "left_anti")


def spans(located: DataFrame) -> DataFrame:
    """``row, kind, start, end`` of the base spans and of the weak ones that linking confirms."""
    parts = materialize(_parts(located), "parts")
    base, weak = parts.filter(F.col("kind") < len(BASE)), parts.filter(F.col("kind") >= len(BASE))
    # A weak candidate that overlaps a part of an earlier kind is that part seen again.
    weak = _near(weak, parts, 0, F.col("o_kind") < F.col("kind"), "left_anti")
    weak = materialize(weak, "weak")
    fits = F.lit(False)
    for kind, roles in NEEDS.items():
        partners = [i for i, k in enumerate(KINDS) if ROLE[k] in roles]
        fits = fits | ((F.col("kind") == KINDS.index(kind)) & F.col("o_kind").isin(partners))
    return base.union(_near(weak, base.union(weak), REACH, fits, "left_semi"))


def _listed(only_base: bool) -> Column:
    """The collected spans by start, then kind, as ``kind:start:end`` joined by commas."""
    some = F.array_sort(F.collect_list(F.when(
        F.col("kind") < (len(BASE) if only_base else len(KINDS)),
        F.struct("start", "kind", "end"),
    )))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(some, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Positions count code points, ends are exclusive. A null or empty text has no
    spans; equal rows are reported alike, once for each; an empty table gives none.
    Texts are scanned whole, however long; columns other than ``doc_id`` and ``text``
    are not read, whatever their names.
    """
    located = _located(docs)
    found = spans(located).groupBy("row").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        _listed(True).alias("base"), _listed(False).alias("spans"),
    )
    return located.select("row", "doc_id").join(found, "row", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret part of its texts replaced by ``MASK``.

    Identifiers that stand in the base patterns and secrets are masked, weak
    identifiers and endpoints are left. ``n_chars`` follows the text where it is a
    column. Texts without a match pass untouched and are not moved, and so do other
    columns, whatever their names.
    """
    key, held = free_name(docs, "key"), free_name(docs, "held")
    flagged = docs.filter(suspect())
    located = _located(flagged)
    masked = [i for i, k in enumerate(KINDS) if k in BASE or ROLE[k] == "secret"]
    found = spans(located).filter(F.col("kind").isin(masked))
    earlier = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    # Overlapping spans are masked as one.
    grouped = found.withColumn("new", (F.coalesce(reached, F.lit(-1)) <= F.col("start")).cast("int"))
    grouped = grouped.withColumn("group", F.sum("new").over(earlier))
    whole = grouped.groupBy("row", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    lists = whole.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(held))
    by_key = located.join(lists, "row").groupBy(F.col("key").alias(key)).agg(
        F.first(held).alias(held)
    )
    joined = flagged.withColumn(key, key_of()).join(by_key, key, "left")
    n = F.size(held)
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        F.col("text"),
        (F.when(i > 0, F.get(F.col(held), i - 1)["end"]).otherwise(0) + 1).cast("int"),
        (F.coalesce(F.get(F.col(held), i)["start"], F.length("text").cast("long"))
         - F.when(i > 0, F.get(F.col(held), i - 1)["end"]).otherwise(0)).cast("int"),
    ))
    text = F.when(F.col(held).isNotNull(), F.array_join(pieces, MASK)).otherwise(F.col("text"))
    masked_rows = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked_rows = masked_rows.withColumn(
            "n_chars", F.when(F.col(held).isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return docs.filter(~suspect()).union(masked_rows.select(*docs.columns))
