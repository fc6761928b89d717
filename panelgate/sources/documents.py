"""Example tables kept as split JSON documents."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgate.columns import named

_SPLIT = "columns array<string>, data array<array<double>>"


def explode_split_json(
    df: DataFrame, json_col: str, columns: Sequence[str], position: str | None = None
) -> DataFrame:
    """One row per data row of every ``{"columns": [..], "data": [[..], ..]}`` document.

    The other columns of ``df`` are repeated. Each wanted column is found by its
    name, once per document. Broken documents, documents without a wanted column
    and rows of the wrong length fail the job. ``position`` adds the row's place in
    its document.
    """
    kept = [c for c in df.columns if c != json_col]
    document = F.from_json(named(json_col), _SPLIT, {"mode": "FAILFAST"})
    parsed = df.select(*[named(c) for c in kept], document.alias("_doc"))
    places = F.array(
        *[F.array_position("_doc.columns", F.lit(c)).cast("int") for c in columns]
    )
    located = parsed.select(
        *[named(c) for c in kept],
        F.size("_doc.columns").alias("_width"),
        places.alias("_places"),
        F.col("_doc.data").alias("_data"),
    )
    # The outer form keeps Spark from parsing every document once more in a filter
    # on its size; documents without rows are dropped right after.
    rows = located.select(
        *[named(c) for c in kept],
        "_width",
        "_places",
        F.posexplode_outer("_data").alias("_pos", "_row"),
    ).filter(F.col("_pos").isNotNull())
    fits = F.size("_row") == F.col("_width")
    cells = []
    for i, c in enumerate(columns):
        place = F.col("_places")[i]
        cell = F.get("_row", place - 1)
        cells.append(
            F.when(fits & (place > 0), cell)
            .otherwise(F.raise_error(F.lit(f"document row without a value for {c}")))
            .alias(c)
        )
    extra = [F.col("_pos").alias(position)] if position else []
    return rows.select(*[named(c) for c in kept], *extra, *cells)
