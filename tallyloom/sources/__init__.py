"""Sources: where rows come from."""

from tallyloom.sources.files import (
    all_presets,
    backup_files,
    dashboard_signals,
    deflate,
    inflate,
    keys_like,
    preset_items,
    range_series,
    rate_table,
    signal_catalog,
    signals_of,
    slow_query_entries,
    slow_query_log,
)
from tallyloom.sources.tables import jdbc_table, read_table, write_jdbc

__all__ = [
    "all_presets",
    "backup_files",
    "dashboard_signals",
    "deflate",
    "inflate",
    "jdbc_table",
    "keys_like",
    "preset_items",
    "range_series",
    "rate_table",
    "read_table",
    "signal_catalog",
    "signals_of",
    "slow_query_entries",
    "slow_query_log",
    "write_jdbc",
]
