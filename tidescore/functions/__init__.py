from tidescore.functions.columns import (
    add_date_updated,
    add_nulls,
    any_null,
    as_list,
    cap_rows,
    cast_date_if_present,
    choose,
    epoch_ms_to_ntz,
    newer,
    nullify,
    project_features,
    stamp_run,
    tag_dropped,
)
from tidescore.functions.frames import inline_rows, pending, stack_distinct

__all__ = [
    "add_date_updated",
    "add_nulls",
    "any_null",
    "as_list",
    "cap_rows",
    "cast_date_if_present",
    "choose",
    "epoch_ms_to_ntz",
    "inline_rows",
    "newer",
    "nullify",
    "pending",
    "project_features",
    "stack_distinct",
    "stamp_run",
    "tag_dropped",
]
