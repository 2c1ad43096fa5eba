"""Tables that are replaced without a gap: each version is a table of its own, and a view shows the current one."""

from __future__ import annotations

import time
from collections.abc import Mapping
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tidescore.functions.columns import cap_rows
from tidescore.sources.tables import get_property, load, set_properties, store, table_exists

# Between a table's name and the number of a version; the number of a plain table that was there before the first one.
VERSION, PLAIN = "__v_", "0" * 20
# A property of a version: the one before it.
BEFORE = "published.before"


def is_view(spark: SparkSession, name: str) -> bool:
    return table_exists(spark, name) and spark.catalog.getTable(name).tableType == "VIEW"


def published_version(spark: SparkSession, name: str) -> str | None:
    """The table that shows under this name, or None if it is not a view that ``publish_table`` made."""
    if not is_view(spark, name):
        return None
    texts = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'View Text'").collect()
    target = texts[-1]["data_type"].removeprefix("SELECT * FROM ")
    return target if target.startswith(f"{name}{VERSION}") else None


def publish_table(spark: SparkSession, source: str | DataFrame, name: str, *, args: Mapping | None = None,
                  limit: int | None = None) -> DataFrame:
    """Replace what shows under a name by the rows of a frame or of SQL, which may read what it replaces.

    The rows are written to a table of their own, and then the view of that name is pointed at it by one statement. A
    reader sees the old rows or the new ones, and a run that breaks off at any point leaves one of them. The version
    before the new one stays until the next is published, for readers that have begun with it; what a
    broken-off run leaves has a name of its own and is in nobody's way. A plain table of this name becomes
    the first version; this once, the name is absent between two renames, and ``restore_published`` puts a break there right.
    """
    restore_published(spark, name)
    df = spark.sql(source, args=dict(args or {})) if isinstance(source, str) else source
    new = f"{name}{VERSION}{time.time_ns():020d}_{uuid4().hex[:12]}"
    store(cap_rows(df, limit), new)
    if table_exists(spark, name) and not is_view(spark, name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}{VERSION}{PLAIN}")
        restore_published(spark, name)
    old = published_version(spark, name)
    if old is None:
        spark.sql(f"CREATE VIEW {name} AS SELECT * FROM {new}")
        return load(spark, name)
    before = get_property(spark, old, BEFORE)
    set_properties(spark, new, {BEFORE: old})
    spark.sql(f"ALTER VIEW {name} AS SELECT * FROM {new}")
    if before:
        spark.sql(f"DROP TABLE IF EXISTS {before}")
    return load(spark, name)


def restore_published(spark: SparkSession, name: str) -> None:
    """Show a plain table again that was renamed to become the first version, if its name was left absent."""
    plain = f"{name}{VERSION}{PLAIN}"
    if not table_exists(spark, name) and table_exists(spark, plain):
        spark.sql(f"CREATE VIEW {name} AS SELECT * FROM {plain}")


def drop_published(spark: SparkSession, name: str) -> None:
    """Drop the view and its current and former version."""
    current = published_version(spark, name)
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    if current is not None:
        before = get_property(spark, current, BEFORE)
        for version in (current, before):
            if version:
                spark.sql(f"DROP TABLE IF EXISTS {version}")
