"""A process of its own that merges into a wide table which it knows by its folder only. Used by test_wide.py."""

import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidescore.operators import ConcurrentMergeError, merge_into_wide, wide


def main(folder: str, shared: str, value: str, ready: str, go: str) -> None:
    spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", f"{shared}/{value}")
             .config("spark.checkpoint.dir", shared).getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    spark.sql(f"CREATE TABLE wide (k INT, v STRING, execution_date DATE, wt_bucket INT) USING parquet "
              f"PARTITIONED BY (wt_bucket) LOCATION '{folder}' TBLPROPERTIES ('wide.buckets' = '2')")
    spark.sql("ALTER TABLE wide RECOVER PARTITIONS")
    plain = wide._delta_stats

    def together(*arguments):
        """Both processes have read the table's state when either goes on."""
        found = plain(*arguments)
        Path(ready).touch()
        while not Path(go).exists():
            time.sleep(0.05)
        return found

    wide._delta_stats = together
    delta = spark.range(50).select(F.col("id").cast("int").alias("k"), F.lit(value).alias("v"),
                                   F.lit("2024-01-02").cast("date").alias("execution_date"))
    try:
        merge_into_wide(spark, "wide", delta, "k")
        print("merged")
    except ConcurrentMergeError:
        print("refused")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
