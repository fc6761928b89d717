"""Naming and path expressions of the model ledgers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelgate.columns import as_column, converted, required

# Fixed value: every description of an exported version starts with it.
EXPORT_MARKER = "Already Exported "


def workspace_id(c) -> Column:
    """Second ``_``-separated piece: ``workspace_a_b`` gives ``a``; no ``_`` is an error."""
    c = as_column(c)
    return converted(c, F.get(F.split(c, "_"), F.lit(1)), "no workspace id in")


def parent_path(c) -> Column:
    """Everything before the last ``/``; unchanged without one."""
    return F.regexp_replace(as_column(c), r"/[^/]*\z", "")


def last_segment(c) -> Column:
    """Everything after the last ``/``."""
    return F.substring_index(as_column(c), "/", -1)


def prefixed(c, prefix: str) -> Column:
    return F.concat(F.lit(prefix), as_column(c))


def location(*parts) -> Column:
    """Parts joined by ``/``. A null part is an error, it must not shorten the path."""
    checked = [required(as_column(p), "a location part is null") for p in parts]
    return F.concat_ws("/", *checked)


def replace_text(c, old: str, new: str) -> Column:
    """Literal replacement of every occurrence."""
    return F.replace(as_column(c), F.lit(old), F.lit(new))


def exported_description(c) -> Column:
    """Description of a version after its export, keeping the old text."""
    return F.concat(
        F.lit(EXPORT_MARKER + ", old description: "), F.coalesce(as_column(c), F.lit(""))
    )
