"""Helpers that several operators share: reading documents, scratch folders, samples and free column names."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescore.sources.scratch import shared_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; any other column may have any name."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not use."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_places(values: Column, places: Column) -> Column:
    """An array without the elements at some places (from 0, ascending), in time proportional to its length.

    What stands between two places is one slice. The array is the variable of the outer function, so it is built once.
    """
    def kept(held: Column) -> Column:
        def between(at: Column) -> Column:
            start = F.when(at == 0, 0).otherwise(F.get(places, at - 1) + 1)
            return F.slice(held, start + 1, F.coalesce(F.get(places, at), F.size(held)) - start)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), between))
    return F.get(F.transform(F.array(values), kept), F.lit(0))


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor. A null id counts as the empty text."""
    text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def folder(spark: SparkSession, name: str) -> str:
    """A new path inside the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}_{uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path that ``folder`` gave, through the file system that the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a frame once and read it back, which cuts its lineage."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample_by_class(df: DataFrame, label: str, id_col: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows, shared evenly over the classes, chosen by a hash of the id.

    Only the counts per class come to the driver, and the sample never moves before it is chosen.
    """
    counts = {row[0]: row[1] for row in df.groupBy(label).count().collect()}
    if not counts:
        return df
    share, left, rates = max_rows, len(counts), {}
    for value, n in sorted(counts.items(), key=lambda item: item[1]):
        take = min(n, share // left)
        rates[value], share, left = take / n, share - take, left - 1
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(f"`{id_col}`")), F.lit(1_000_000)) / 1_000_000
    chosen = F.lit(False)
    for value, rate in rates.items():
        chosen = chosen | ((F.col(label) == F.lit(value)) & (draw < F.lit(rate)))
    return df.filter(chosen)
