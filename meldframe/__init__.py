"""meldframe: dataset I/O, keyed dedup, entity matching, merge and incremental sync as Spark plans."""

from meldframe.functions.text import normalize_text
from meldframe.operators.catalog import drop_database_tables, scan_databases, search_database, write_dictionary
from meldframe.operators.columns import clean_columns
from meldframe.operators.keyed import latest_by_key, ordered_list_by_key
from meldframe.operators.keyed import latest_by_key as dedupe
from meldframe.operators.matching import exact_match, fill_missing_from_match, fuzzy_match, infer_key_from_text, ml_fuzzy_match, ngram_match
from meldframe.operators.merge import DEFAULT_CDF_METADATA, cdf_merge, column_map, current_delta_version, merge_condition, read_cdf, snapshot_merge, upsert
from meldframe.plans.parallel import quiet_azure_logging, run_parallel
from meldframe.plans.pipeline import transform, transform_df
from meldframe.plans.sync import SyncAudit, SyncAuditRow, SyncResult, SyncSpec, SyncState, load_specs, run_sync, sync_delta_to_table
from meldframe.session import get_spark, set_spark
from meldframe.sources.io import Input, Output
from meldframe.sources.versions import VersionedTable

__version__ = "0.1.0"

__all__ = [
    "DEFAULT_CDF_METADATA",
    "Input",
    "Output",
    "SyncAudit",
    "SyncAuditRow",
    "SyncResult",
    "SyncSpec",
    "SyncState",
    "VersionedTable",
    "cdf_merge",
    "clean_columns",
    "column_map",
    "current_delta_version",
    "dedupe",
    "drop_database_tables",
    "exact_match",
    "fill_missing_from_match",
    "fuzzy_match",
    "get_spark",
    "infer_key_from_text",
    "latest_by_key",
    "load_specs",
    "merge_condition",
    "ml_fuzzy_match",
    "ngram_match",
    "normalize_text",
    "ordered_list_by_key",
    "quiet_azure_logging",
    "read_cdf",
    "run_parallel",
    "run_sync",
    "scan_databases",
    "search_database",
    "set_spark",
    "snapshot_merge",
    "sync_delta_to_table",
    "transform",
    "transform_df",
    "upsert",
    "write_dictionary",
]
