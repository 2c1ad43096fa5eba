"""Loading, storing, creating, replacing, moving and dropping tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidescore.functions.columns import as_list, cap_rows
from tidescore.functions.frames import inline_rows, stack_distinct


# Between a table's name and a unique one, for the old table while a swap is going on.
REPLACED = "__replaced_"


def is_path(name: str) -> bool:
    return "/" in name


def load(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by its one to three part name, or a parquet path."""
    return spark.read.parquet(name) if is_path(name) else spark.table(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def store(df: DataFrame, name: str, mode: str = "overwrite",
          partition_by: str | Sequence[str] | None = None) -> None:
    """Write parquet under a table name or a path: ``overwrite`` replaces, ``append`` adds by column name."""
    writer = df.write.format("parquet").mode(mode)
    if partition_by:
        writer = writer.partitionBy(*as_list(partition_by))
    if is_path(name):
        writer.save(name)
    else:
        writer.saveAsTable(name)


def _pairs(properties: Mapping[str, str]) -> str:
    return ", ".join(f"'{key}' = '{value}'" for key, value in properties.items())


def set_properties(spark: SparkSession, name: str, properties: Mapping[str, str]) -> None:
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({_pairs(properties)})")


def get_property(spark: SparkSession, name: str, key: str) -> str | None:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").filter(f"key = '{key}'").collect()
    return rows[0]["value"] if rows else None


def create_table(spark: SparkSession, source: str | DataFrame, name: str, *, swap: bool = False,
                 limit: int | None = None, args: Mapping | None = None) -> DataFrame:
    """Create or replace a table from SQL text (with named parameters ``args``) or from a frame.

    With ``swap`` the rows are first written next to the table and then renamed into place, so the
    query may read the table it replaces, and a failing query leaves the old table as it was. The old table is
    renamed before it is dropped; a run that breaks off in between is put right by ``restore_table``, which
    this begins with. What is left of a broken-off write has a name of its own and is in nobody's way.
    """
    if swap:
        restore_table(spark, name)
    df = spark.sql(source, args=dict(args)) if isinstance(source, str) and args else source
    df = spark.sql(df) if isinstance(df, str) else df
    df = cap_rows(df, limit)
    if not swap:
        store(df, name)
        return load(spark, name)
    staged = f"{name}__new_{uuid4().hex[:12]}"
    store(df, staged)
    old = f"{name}{REPLACED}{time.time_ns():020d}_{uuid4().hex[:12]}"
    if table_exists(spark, name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    drop_tables(spark, [old])
    return load(spark, name)


def restore_table(spark: SparkSession, name: str) -> None:
    """Undo or finish a swap that broke off: the renamed old table comes back, or goes if the new one is there.

    Of several old ones the newest comes back, and the others stay until the next swap.
    """
    schema, _, table = name.rpartition(".")
    within = f" IN {schema}" if schema else ""
    found = spark.sql(f"SHOW TABLES{within} LIKE '{table}{REPLACED}*'").collect()
    old = sorted(f"{schema}.{row.tableName}" if schema else row.tableName for row in found)
    if table_exists(spark, name):
        drop_tables(spark, old)
    elif old:
        spark.sql(f"ALTER TABLE {old[-1]} RENAME TO {name}")


def create_table_with(spark: SparkSession, build: Callable[..., DataFrame], input_table: str, name: str,
                      **arguments) -> DataFrame:
    """Create or replace a table with a user function from the input frame to the output frame."""
    return create_table(spark, load(spark, input_table).transform(build, **arguments), name)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType | str, *,
                 partition_by: str | Sequence[str] | None = None, properties: Mapping[str, str] | None = None,
                 options: Mapping[str, str] | None = None) -> DataFrame:
    """Create an empty table with a declared schema unless it exists; ``options`` hold for its writers."""
    if not table_exists(spark, name):
        fields = schema if isinstance(schema, str) else schema.toDDL()
        parts = f" PARTITIONED BY ({', '.join(as_list(partition_by))})" if partition_by else ""
        tags = f" TBLPROPERTIES ({_pairs(properties)})" if properties else ""
        settings = f" OPTIONS ({_pairs(options)})" if options else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet{settings}{parts}{tags}")
    return load(spark, name)


def insert_rows(df: DataFrame, name: str) -> None:
    """Append rows to a table by column name, widened to the table's types."""
    columns = df.sparkSession.table(name).columns
    df.select(*columns).write.insertInto(name)


def drop_tables(spark: SparkSession, names: Iterable[str | None]) -> None:
    """Drop each named table or view if it is there; missing names are skipped. A published table goes with its versions."""
    from tidescore.sources.versions import drop_published, is_view

    for name in names:
        if name and is_view(spark, name):
            drop_published(spark, name)
        elif name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_listed_tables(spark: SparkSession, work_lists: Sequence[DataFrame],
                       columns: Sequence[str] = ("table_name", "enriched_table_name")) -> None:
    """Drop every table that any of the work lists names in one of the columns."""
    listed = stack_distinct(work_lists, columns, alias="table_name").dropna()
    drop_tables(spark, (row.table_name for row in listed.toLocalIterator()))


def move_with_view(spark: SparkSession, name: str, new_name: str) -> None:
    """Rename a table and leave a view of it under its old name."""
    spark.sql(f"ALTER TABLE {name} RENAME TO {new_name}")
    spark.sql(f"CREATE VIEW {name} AS SELECT * FROM {new_name}")


def replace_rows(spark: SparkSession, name: str, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """Replace a small control table by rows held by the caller. Whoever runs this decides about another try."""
    store(inline_rows(spark, rows, schema, distinct=False), name)
    return load(spark, name)
