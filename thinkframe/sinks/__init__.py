"""Writers for records, catalog, traces, summaries and report tables (K1-K6)."""

from .catalog import catalog_history, commit_catalog, read_catalog
from .writers import write_csv_table, write_json_arrays, write_records, write_run_summaries, write_traces

__all__ = ["write_records", "commit_catalog", "read_catalog", "catalog_history", "write_csv_table", "write_traces",
           "write_run_summaries", "write_json_arrays"]
