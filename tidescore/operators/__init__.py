from tidescore.operators.asof import enrich_features
from tidescore.operators.audit import (
    CoverageError,
    EmptyKernelError,
    coverage,
    dropped_rows,
    funnel_audit,
    require_coverage,
    stored_coverage,
    validate_results,
)
from tidescore.operators.freshness import snapshot_max_ts, snapshot_ready
from tidescore.operators.history import append_to_history, history_rows
from tidescore.operators.lookup import fill_missing, join_result
from tidescore.operators.once import append_once
from tidescore.operators.outbox import events_to_write, exclude_seen, outbox_row, seen_since, write_events
from tidescore.operators.scoring import score, score_with_columns
from tidescore.operators.skew import anti_join, broadcast_if_small, hot_keys, is_small, left_join
from tidescore.operators.wide import (
    ConcurrentMergeError,
    DuplicateKeyError,
    merge_into_wide,
    newest_per_key,
    read_wide,
    upsert_newest,
)

__all__ = [
    "ConcurrentMergeError",
    "CoverageError",
    "DuplicateKeyError",
    "EmptyKernelError",
    "anti_join",
    "append_once",
    "append_to_history",
    "broadcast_if_small",
    "coverage",
    "dropped_rows",
    "enrich_features",
    "events_to_write",
    "exclude_seen",
    "fill_missing",
    "funnel_audit",
    "history_rows",
    "hot_keys",
    "is_small",
    "join_result",
    "left_join",
    "merge_into_wide",
    "newest_per_key",
    "outbox_row",
    "read_wide",
    "require_coverage",
    "score",
    "score_with_columns",
    "seen_since",
    "snapshot_max_ts",
    "snapshot_ready",
    "stored_coverage",
    "upsert_newest",
    "validate_results",
    "write_events",
]
