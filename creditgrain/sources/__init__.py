from .adapters import line_facts, txns_from_events, txns_from_facts, txns_from_lines
from .splits import load_splits, save_splits
from .transactions import conform, from_records, parse_times, read_transactions, read_with_rejects
from .validation import validate_transactions

__all__ = [
    "conform",
    "from_records",
    "line_facts",
    "load_splits",
    "parse_times",
    "read_transactions",
    "read_with_rejects",
    "save_splits",
    "txns_from_events",
    "txns_from_facts",
    "txns_from_lines",
    "validate_transactions",
]
