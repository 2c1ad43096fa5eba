"""A work list: tables to enrich, each with the name of its result once there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidescore.operators.lookup import fill_missing
from tidescore.sources.tables import load, restore_table
from tidescore.sources.versions import publish_table, restore_published


class WorkFailed(RuntimeError):
    """Some of the work on the list failed; what succeeded is stored."""


def update_work_list(spark: SparkSession, name: str, finished: DataFrame, key: str = "table_name",
                     column: str = "enriched_table_name", failed: bool = False) -> DataFrame:
    """Fill the results of finished work into the list, replace the list, and only then report failures.

    The list is published: who reads it meanwhile sees the old one or the new one.
    """
    restore_table(spark, name)
    restore_published(spark, name)
    filled = fill_missing(load(spark, name), finished.select(key, column).distinct(), key, column)
    stored = publish_table(spark, filled, name)
    if failed:
        raise WorkFailed(f"some work of {name} failed; its results so far are stored")
    return stored
