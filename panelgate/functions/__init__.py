from panelgate.functions.numbers import (
    quarter_of,
    relative_difference,
    squared_error,
    strict_double,
    version_number,
)
from panelgate.functions.text import (
    exported_description,
    last_segment,
    location,
    parent_path,
    prefixed,
    replace_text,
    workspace_id,
)

__all__ = [
    "exported_description",
    "last_segment",
    "location",
    "parent_path",
    "prefixed",
    "quarter_of",
    "relative_difference",
    "replace_text",
    "squared_error",
    "strict_double",
    "version_number",
    "workspace_id",
]
