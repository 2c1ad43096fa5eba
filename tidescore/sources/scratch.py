"""Where intermediate tables live: a schema inside the folder named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidescore-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_schema(spark: SparkSession, prefix: str = "scratch") -> str:
    """Create a schema in the shared folder; DROP SCHEMA ... CASCADE removes its tables and their files."""
    name = f"{prefix}_{uuid4().hex[:12]}"
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{shared_dir(spark)}/{name}'")
    return name


def named_schema(spark: SparkSession, name: str) -> str:
    """A schema of this name in the shared folder, created unless it is there."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name} LOCATION '{shared_dir(spark)}/{name}'")
    return name


def drop_schema(spark: SparkSession, schema: str) -> None:
    spark.sql(f"DROP SCHEMA IF EXISTS {schema} CASCADE")


COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


@contextmanager
def apart(spark: SparkSession) -> Iterator[None]:
    """While rows that are brought together by date or bucket are written, small tasks are not joined into one.

    Each date is in one task anyway unless it is large, so joined tasks make no fewer files, but write them one after another.
    """
    before = spark.conf.get(COALESCE, None)
    spark.conf.set(COALESCE, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(COALESCE)
        else:
            spark.conf.set(COALESCE, before)


def stage(df: DataFrame, schema: str, name: str) -> DataFrame:
    """Write a frame once and return the stored table.

    This cuts the lineage: what reads the result neither repeats the work nor depends on a live executor.
    """
    table = f"{schema}.{name}"
    df.write.mode("overwrite").format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


@contextmanager
def scratch(spark: SparkSession, prefix: str = "scratch") -> Iterator[str]:
    """A scratch schema that is dropped at the end, also after a failure."""
    name = scratch_schema(spark, prefix)
    try:
        yield name
    finally:
        drop_schema(spark, name)
