"""Appends that take place once for each run, however often the run is tried."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from tidescore.functions.columns import as_list
from tidescore.operators.wide import as_target
from tidescore.sources.commits import Log
from tidescore.sources.tables import ensure_table, load, table_exists


def _record(run: str) -> str:
    return sha256(run.encode()).hexdigest()[:40]


def has_appended(spark: SparkSession, name: str, run: str) -> bool:
    """Whether this run's rows are in the table; an append that broke off after its record is finished first."""
    if not table_exists(spark, name):
        return False
    log, record = Log(spark, name, "appends"), _record(run)
    if not log.has(record):
        return False
    log.finish(record)
    return True


def append_once(df: DataFrame, name: str, run: str, partition_by: str | Sequence[str] = ()) -> bool:
    """Append rows to a table, which is created if need be; False if this run has appended to it before.

    The rows are written once, and a record of the run then decides. A break before the record leaves the table
    as it was, and one after it is finished by the next try. The rows need the table's columns, and values that fit their types.
    """
    spark = df.sparkSession
    if has_appended(spark, name, run):
        return False
    ensure_table(spark, name, df.schema, partition_by=as_list(partition_by))
    log, record = Log(spark, name, "appends"), _record(run)
    stored = load(spark, name)
    more = [column for column in df.columns if column not in stored.columns]
    if more:
        raise ValueError(f"{name} has no columns {more}")
    partitions = [column.name for column in spark.catalog.listColumns(name) if column.isPartition]
    change = log.stage(as_target(stored, df), partitions)
    change.says = {"run": run}
    first = log.commit(record, change)
    log.finish(record)
    return first
