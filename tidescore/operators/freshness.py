"""Whether a snapshot has arrived, and how far it reaches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescore.functions.columns import epoch_ms_to_ntz


def snapshot_max_ts(df: DataFrame, day: str | dt.date, ms_column: str,
                    partition_column: str | None = "partition_date") -> DataFrame:
    """One row (max_ts): the latest time of the day in the day's partition, null while there is none.

    The day is tested as a range of the stored milliseconds, which the scan can use to skip row groups,
    and the one maximum is converted afterwards.
    """
    day = dt.date.fromisoformat(str(day)[:10])
    start = (day - dt.date(1970, 1, 1)).days * 86_400_000
    rows = df.filter((F.col(ms_column) >= start) & (F.col(ms_column) < start + 86_400_000))
    if partition_column:
        rows = rows.filter(F.col(partition_column) == F.lit(day))
    return rows.agg(F.max(ms_column).alias("ms")).select(epoch_ms_to_ntz(F.col("ms")).alias("max_ts"))


def snapshot_ready(df: DataFrame, day: str | dt.date, ms_column: str,
                   partition_column: str | None = "partition_date"):
    """The latest time of the day's snapshot, or None while it has not arrived."""
    return snapshot_max_ts(df, day, ms_column, partition_column).first()[0]
