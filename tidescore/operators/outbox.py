"""Events for keys that have not had one yet, and the registry row that announces them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescore.functions.columns import cap_rows
from tidescore.operators.once import append_once, has_appended
from tidescore.operators.skew import anti_join
from tidescore.sources.tables import create_table, insert_rows, store, table_exists


def seen_since(evid: int, since, until=None, *, evid_column: str = "evid",
               date_column: str = "date_created") -> Column:
    """Events of one kind from ``since`` to ``until``, both included; by default until tomorrow 00:00.

    The bounds are literals, so they reach the scan as pushed filters and prune partitions.
    """
    last = F.date_add(F.current_date(), 1) if until is None else F.lit(until).cast("date")
    return (F.col(evid_column) == evid) & F.col(date_column).between(F.lit(since).cast("date"), last)


def exclude_seen(df: DataFrame, seen: DataFrame, key: str | Sequence[str],
                 where: Column | None = None) -> DataFrame:
    """Rows whose key is not among the seen ones; repeated rows and rows with a null key stay."""
    return anti_join(df, seen if where is None else seen.filter(where), key)


def events_to_write(df: DataFrame, key: str | Sequence[str], seen: DataFrame | None = None,
                    where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Source rows without the keys already sent, capped after the exclusion."""
    return cap_rows(df if seen is None else exclude_seen(df, seen, key, where), limit)


def outbox_row(spark: SparkSession, table_name: str, evid: int, *, source_number: int, endpoint: str,
               priority: int, drop_table: bool = True, now=None) -> DataFrame:
    """The registry's row for one events table."""
    created = F.localtimestamp() if now is None else F.lit(now).cast("timestamp_ntz")
    return spark.range(1).select(
        created.alias("date_created"),
        F.lit(table_name).alias("table_name"),
        F.lit(endpoint).alias("endpoint"),
        F.lit(source_number).alias("source_number"),
        F.lit(evid).alias("evid"),
        F.lit(drop_table).alias("drop_table"),
        F.lit(priority).alias("priority"),
    )


def write_events(events: DataFrame, events_table: str, registry: str, evid: int, *, run: str | None = None,
                 **registry_values) -> None:
    """Replace the events table by the rows, which may come from that table, then announce it in the registry.

    With the name of a ``run`` the table is announced once for that run: a run that broke off between the rows and the
    announcement is tried again as a whole, and one that was announced writes nothing.
    """
    spark = events.sparkSession
    row = outbox_row(spark, events_table, evid, **registry_values)
    token = f"{events_table} {run}"
    if run is not None and has_appended(spark, registry, token):
        return
    create_table(spark, events, events_table, swap=True)
    if run is not None:
        append_once(row, registry, token)
    elif table_exists(spark, registry):
        insert_rows(row, registry)
    else:
        store(row, registry)
