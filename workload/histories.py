"""History tables, read back after writing."""

from pyspark.sql import functions as F

from tidescore.operators import append_to_history
from tidescore.sources import scratch_schema
from workload.registry import query, table


@query("""
    SELECT event_id, user_id, event_type, value, 'daily' AS run_type, CAST(ts AS DATE) AS execution_date
    FROM events""")
def history_by_date_column(spark, sf_dir):
    name = f"{scratch_schema(spark, 'query')}.history"
    events = table(spark, sf_dir, "events").withColumn("execution_date", F.col("ts"))
    append_to_history(events, name, "daily",
                      columns="event_id,user_id,event_type,value,execution_date")
    return spark.table(name)


@query("""
    SELECT doc_id, lang, source, CAST(NULL AS VARCHAR) AS remark, 'monthly' AS run_type,
           DATE '2024-02-01' AS execution_date
    FROM documents
    UNION ALL
    SELECT doc_id, lang, source, NULL, 'monthly', DATE '2024-03-01' FROM documents WHERE lang = 'en'""")
def history_by_given_date(spark, sf_dir):
    name = f"{scratch_schema(spark, 'query')}.history"
    documents = table(spark, sf_dir, "documents")
    for day, rows in (("2024-02-01", documents), ("2024-03-01", documents.filter("lang = 'en'"))):
        append_to_history(rows, name, "monthly", day, columns="doc_id,lang,source",
                          nulls={"remark": "string"})
    return spark.table(name)


@query("""
    SELECT c_custkey, c_nationkey, 'daily' AS run_type, DATE '2024-02-01' AS execution_date
    FROM customer WHERE c_acctbal > 0
    UNION ALL SELECT c_custkey, c_nationkey, 'backfill', DATE '2024-02-01' FROM customer""")
def history_replace_run(spark, sf_dir):
    """A repeated run replaces its own rows and leaves the other run's."""
    name = f"{scratch_schema(spark, 'query')}.history"
    customers = table(spark, sf_dir, "customer")
    runs = (("daily", customers), ("backfill", customers), ("daily", customers.filter("c_acctbal > 0")))
    for run_type, rows in runs:
        append_to_history(rows, name, run_type, "2024-02-01", columns="c_custkey,c_nationkey", replace_run=True)
    return spark.table(name)


@query("""
    SELECT event_id, event_type, run_type, CAST(ts AS DATE) AS execution_date FROM events, (VALUES ('daily'), ('backfill')) AS runs(run_type)
    WHERE run_type = 'daily' OR event_type <> 'click'""")
def history_once_for_each_run(spark, sf_dir):
    """Two runs, each tried twice; every run's rows are there once, under the events' own dates."""
    name = f"{scratch_schema(spark, 'query')}.history"
    events = table(spark, sf_dir, "events").withColumn("execution_date", F.col("ts"))
    for run_type, rows in (("daily", events), ("backfill", events.filter("event_type <> 'click'"))):
        for _ in range(2):
            append_to_history(rows, name, run_type, columns="event_id,event_type,execution_date", run=f"{run_type} 2024-03-01")
    return spark.table(name)
