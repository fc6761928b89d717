from panelgate.sources.documents import explode_split_json
from panelgate.sources.tables import (
    ledger_row,
    published_versions,
    read_indicators,
    read_path,
    read_published,
    read_table,
)

__all__ = [
    "explode_split_json",
    "ledger_row",
    "published_versions",
    "read_indicators",
    "read_path",
    "read_published",
    "read_table",
]
