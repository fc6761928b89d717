from panelgate.plans.ledgers import export_ledger_rows, import_ledger_rows, import_locations
from panelgate.plans.monitoring import monitor, validate_and_promote
from panelgate.plans.training import build_training_table, build_training_tables

__all__ = [
    "build_training_table",
    "build_training_tables",
    "export_ledger_rows",
    "import_ledger_rows",
    "import_locations",
    "monitor",
    "validate_and_promote",
]
