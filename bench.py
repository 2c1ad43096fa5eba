"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_REPEATS choose the tables, the cores and the runs of each query. With
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescore.sources import drop_schema, scratch_schema
from workload import QUERIES
from workload.audits import line_keys
from workload.joins import labels_as_predictions, purchases_and_clicks
from workload.registry import table
from workload.wides import wide_and_delta

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

HEADLINE = [
    "project_features_query", "score_batches", "score_columns", "join_result_query", "join_result_repeated",
    "fill_missing_query", "stack_distinct_query", "enrich_features_query", "nullify_query",
    "snapshot_max_ts_query", "coverage_query", "coverage_matched", "dropped_except", "dropped_not_in",
    "dropped_keep", "validate_results_query", "funnel_audit_query", "funnel_audit_repeats",
    "exclude_seen_query", "history_by_date_column", "history_by_given_date", "upsert_newest_query",
    "upsert_two_dates", "upsert_repeated_delta", "merge_into_wide_query", "create_table_swap",
    "outbox_registry", "store_results_query", "scoring_chain",
]


def session() -> SparkSession:
    folder = tempfile.mkdtemp(prefix="bench-")
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def naive_join_result(spark, sf_dir):
    predictions = labels_as_predictions(spark, sf_dir).drop("lang", "n_chars")
    return table(spark, sf_dir, "documents").join(F.broadcast(predictions), "doc_id", "left")


def naive_dropped_not_in(spark, sf_dir):
    finished = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return spark.sql("SELECT * FROM {l} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {r})",
                     l=line_keys(spark, sf_dir), r=finished)


def naive_validate_results(spark, sf_dir):
    kernel, output = table(spark, sf_dir, "orders").select("o_orderkey"), line_keys(spark, sf_dir)
    kernel.count(), output.count()
    dropped = kernel.subtract(output)
    dropped.count()
    return dropped


def naive_history_by_date_column(spark, sf_dir):
    name = f"{scratch_schema(spark, 'naive')}.history"
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.lit("daily").alias("run_type"),
        F.to_date("ts").alias("execution_date"))
    (events.repartition("execution_date").sortWithinPartitions("execution_date")
     .write.partitionBy("execution_date").saveAsTable(name))
    return spark.table(name)


def naive_enrich_features_query(spark, sf_dir):
    purchases, clicks = purchases_and_clicks(spark, sf_dir)
    clicks = clicks.withColumnRenamed("ts", "click_ts")
    pairs = purchases.join(clicks, "user_id", "left").filter("click_ts IS NULL OR click_ts <= ts")
    return pairs.groupBy("event_id", "user_id", "ts").agg(
        F.max_by(F.struct("click_id", "click_value"), "click_ts").alias("f"))


def naive_merge_into_wide_query(spark, sf_dir):
    """Three times the whole table, by a full outer join."""
    schema = scratch_schema(spark, "naive")
    wide, delta = wide_and_delta(spark, sf_dir)
    wide.write.saveAsTable(f"{schema}.v0")
    for i in (0, 1):
        old = spark.table(f"{schema}.v{i}").alias("w")
        new = delta.alias("d")
        take = F.col("w.custkey").isNull() | F.coalesce(F.col("d.execution_date") > F.col("w.execution_date"), F.lit(False))
        merged = old.join(new, F.col("w.custkey") == F.col("d.custkey"), "full").select(*[
            F.when(take, F.col(f"d.{name}")).otherwise(F.col(f"w.{name}")).alias(name) for name in wide.columns])
        merged.write.saveAsTable(f"{schema}.v{i + 1}")
    return spark.table(f"{schema}.v2")


NAIVE = [naive_join_result, naive_dropped_not_in, naive_validate_results, naive_history_by_date_column,
         naive_enrich_features_query, naive_merge_into_wide_query]


def schemas(spark: SparkSession) -> set[str]:
    return {row[0] for row in spark.sql("SHOW SCHEMAS").collect()}


def timed(spark: SparkSession, query) -> float:
    """The median of some runs, after one that warms up."""
    times = []
    before = schemas(spark)
    for _ in range(REPEATS + 1):
        start = time.perf_counter()
        run(query(spark, SF_DIR))
        times.append(time.perf_counter() - start)
        for name in schemas(spark) - before:
            drop_schema(spark, name)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    spark = session()
    seconds = {name: timed(spark, QUERIES[name]) for name in HEADLINE}
    line = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
            "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1].strip("/")}
    if "--naive" in sys.argv:
        line["naive"] = {query.__name__.removeprefix("naive_"): timed(spark, query) for query in NAIVE}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
