from panelgate.sinks.examples import save_example, to_split_json
from panelgate.sinks.ledgers import append_to_ledger, ensure_ledger
from panelgate.sinks.runs import log_run_values, log_values, run_values
from panelgate.sinks.tables import (
    append_changes,
    append_merge,
    compact,
    publish,
    remove_old,
    save_training_table,
    snapshot_table,
    stage_rows,
    training_table_name,
    update_published,
)

__all__ = [
    "append_changes",
    "append_merge",
    "append_to_ledger",
    "compact",
    "ensure_ledger",
    "log_run_values",
    "log_values",
    "publish",
    "remove_old",
    "run_values",
    "save_example",
    "save_training_table",
    "snapshot_table",
    "stage_rows",
    "to_split_json",
    "training_table_name",
    "update_published",
]
