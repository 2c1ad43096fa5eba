from tidescore.sources.counts import count_rows, count_stored
from tidescore.sources.scratch import drop_schema, scratch_schema, shared_dir, stage
from tidescore.sources.tables import (
    create_table,
    create_table_with,
    drop_listed_tables,
    drop_tables,
    ensure_table,
    insert_rows,
    load,
    move_with_view,
    replace_rows,
    restore_table,
    set_properties,
    store,
    table_exists,
)
from tidescore.sources.versions import publish_table, restore_published

__all__ = [
    "count_rows",
    "count_stored",
    "create_table",
    "create_table_with",
    "drop_listed_tables",
    "drop_schema",
    "drop_tables",
    "ensure_table",
    "insert_rows",
    "load",
    "move_with_view",
    "publish_table",
    "replace_rows",
    "restore_published",
    "restore_table",
    "scratch_schema",
    "set_properties",
    "shared_dir",
    "stage",
    "store",
    "table_exists",
]
