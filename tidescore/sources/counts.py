"""Row counts of stored tables, from the numbers in the footers of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescore.sources.tables import is_path, load


def _folder(spark: SparkSession, name: str) -> str | None:
    """The path under which a table has all its rows and no others, or None where only its reader can tell."""
    if is_path(name):
        return name
    shown = {row.col_name: row.data_type for row in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    is_plain = shown.get("Type") in ("MANAGED", "EXTERNAL") and (shown.get("Provider") or "").lower() == "parquet"
    return shown["Location"] if is_plain and "# Partition Information" not in shown else None


def count_stored(spark: SparkSession, name: str) -> DataFrame:
    """One row with ``n``, the rows of a parquet table or path; no page of any column is read.

    The count is pushed into the scan, so a task reads one footer, however large its file is. The reader that
    can do this is chosen in a session of its own, and the caller's settings stay as they are. Partitioned
    tables, whose partitions can be anywhere, views and other formats are counted by their own reader. The pushed
    count of a table without a file is null; ``count_rows`` makes it 0.
    """
    path, n = _folder(spark, name), F.count(F.lit(1)).alias("n")
    if path is None:
        return load(spark, name).agg(n)
    schema = load(spark, name).schema
    apart = spark.newSession()
    apart.conf.set("spark.sql.sources.useV1SourceList", "")
    apart.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return apart.read.schema(schema).parquet(path).agg(n)


def count_rows(spark: SparkSession, source: DataFrame | str) -> int:
    """The rows of a frame, or of a table or path given by its name."""
    return count_stored(spark, source).first().n or 0 if isinstance(source, str) else source.count()
