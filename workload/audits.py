"""Coverage and dropped rows."""

from pyspark.sql import functions as F

from tidescore.operators import (
    append_to_history,
    coverage,
    dropped_rows,
    exclude_seen,
    funnel_audit,
    seen_since,
    stored_coverage,
    validate_results,
)
from tidescore.sources import scratch_schema, store
from workload.registry import query, table


@query("""
    SELECT d.n AS kernel_count, l.n AS output_count, CAST(l.n AS DOUBLE) / d.n * 100 AS pct,
           CAST(l.n AS DOUBLE) / d.n * 100 >= 99 AS passed
    FROM (SELECT count(*) AS n FROM documents) d, (SELECT count(*) AS n FROM labels) l""")
def coverage_query(spark, sf_dir):
    return coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""
    SELECT o.n AS kernel_count, l.n AS output_count, m.n AS matched_count,
           CAST(l.n AS DOUBLE) / o.n * 100 AS pct, CAST(l.n AS DOUBLE) / o.n * 100 >= 99 AS passed
    FROM (SELECT count(*) AS n FROM orders) o, (SELECT count(*) AS n FROM lineitem) l,
         (SELECT count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) m""")
def coverage_matched(spark, sf_dir):
    """Repeated output rows push the percentage over 100 although some orders have none."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return coverage(table(spark, sf_dir, "orders"), lines, key="o_orderkey")


@query("""
    SELECT o.n AS kernel_count, l.n AS output_count, CAST(l.n AS DOUBLE) / o.n * 100 AS pct,
           CAST(l.n AS DOUBLE) / o.n * 100 >= 99 AS passed
    FROM (SELECT count(*) AS n FROM orders) o, (SELECT count(*) AS n FROM lineitem WHERE l_linenumber = 1) l""")
def coverage_from_footers(spark, sf_dir):
    """The first lines of orders, written as a table, against the orders where they are; no column is read to count."""
    name = f"{scratch_schema(spark, 'query')}.first_lines"
    store(table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_orderkey"), name)
    return stored_coverage(spark, f"{sf_dir}/orders.parquet", name)


@query("""
    SELECT doc_id, 'model_quality' AS drop_step, CAST(1 AS DOUBLE) AS priority
    FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def dropped_except(spark, sf_dir):
    return dropped_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id",
                        "model_quality", nulls="except")


def line_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))


@query("""
    SELECT l_orderkey AS o_orderkey, 'finished' AS drop_step, CAST(2 AS DOUBLE) AS priority
    FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def dropped_not_in(spark, sf_dir):
    finished = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return dropped_rows(line_keys(spark, sf_dir), finished, "o_orderkey", "finished", 2, nulls="sql")


@query("""
    SELECT o_orderkey, 'lines' AS drop_step, CAST(2 AS DOUBLE) AS priority
    FROM orders WHERE o_orderkey NOT IN
      (SELECT nullif(l_orderkey, (SELECT max(l_orderkey) FROM lineitem)) FROM lineitem)""")
def dropped_not_in_null(spark, sf_dir):
    """One null key in the output leaves nothing."""
    lines = line_keys(spark, sf_dir)
    lines = lines.select(F.nullif("o_orderkey", lines.agg(F.max("o_orderkey")).scalar()).alias("o_orderkey"))
    return dropped_rows(table(spark, sf_dir, "orders"), lines, "o_orderkey", "lines", 2, nulls="sql")


@query("""
    SELECT nullif(o_custkey % 50, 7) AS o_custkey, 'empty' AS drop_step, CAST(2 AS DOUBLE) AS priority
    FROM orders WHERE nullif(o_custkey % 50, 7) NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 0)""")
def dropped_not_in_empty(spark, sf_dir):
    """An empty output keeps everything, repeats and null keys too."""
    orders = table(spark, sf_dir, "orders")
    keyed = orders.select(F.nullif(F.col("o_custkey") % 50, F.lit(7)).alias("o_custkey"))
    return dropped_rows(keyed, orders.filter("o_totalprice < 0"), "o_custkey", "empty", 2, nulls="sql")


@query("""
    SELECT k.o_custkey, 'seen' AS drop_step, CAST(1 AS DOUBLE) AS priority
    FROM (SELECT nullif(o_custkey % 50, 7) AS o_custkey FROM orders) k
    LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON k.o_custkey = c.c_custkey
    WHERE c.c_custkey IS NULL""")
def dropped_keep(spark, sf_dir):
    """The anti-join rule: repeats and null keys are kept."""
    keyed = table(spark, sf_dir, "orders").select(
        F.nullif(F.col("o_custkey") % 50, F.lit(7)).alias("o_custkey"))
    building = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return dropped_rows(keyed, building.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "seen",
                        nulls="keep")


@query("""
    SELECT o_orderkey, 'model_lines' AS drop_step, CAST(1 AS DOUBLE) AS priority
    FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""")
def validate_results_query(spark, sf_dir):
    """The gate passes on row counts; the orders without lines are recorded."""
    _, dropped = validate_results(table(spark, sf_dir, "orders"), line_keys(spark, sf_dir), "o_orderkey",
                                  "lines", threshold=99)
    return dropped


def order_funnel(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    unfinished = orders.filter("o_orderstatus <> 'F'")
    large = unfinished.filter("o_totalprice > 150000")
    return [("all_orders", orders), ("unfinished", unfinished), ("large", large),
            ("urgent", large.filter("o_orderpriority = '1-URGENT'"))]


FUNNEL_SQL = """
    SELECT {key} AS {name}, 'unfinished' AS drop_step, CAST(2 AS DOUBLE) AS priority FROM orders
    WHERE {key} NOT IN (SELECT {key} FROM orders WHERE o_orderstatus <> 'F')
    UNION ALL
    SELECT {key}, 'large', 2 FROM orders WHERE o_orderstatus <> 'F' AND {key} NOT IN
      (SELECT {key} FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 150000)
    UNION ALL
    SELECT {key}, 'urgent', 2 FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 150000 AND {key} NOT IN
      (SELECT {key} FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 150000
        AND o_orderpriority = '1-URGENT')"""


@query(FUNNEL_SQL.format(key="o_orderkey", name="o_orderkey"))
def funnel_audit_query(spark, sf_dir):
    return funnel_audit(order_funnel(spark, sf_dir), "o_orderkey")


@query(FUNNEL_SQL.format(key="o_custkey", name="o_custkey"))
def funnel_audit_repeats(spark, sf_dir):
    """The same by customer, whose keys repeat in every step."""
    return funnel_audit(order_funnel(spark, sf_dir), "o_custkey")


@query(f"""
    SELECT o_orderkey, drop_step, priority, 'daily' AS run_type, DATE '2024-03-01' AS execution_date
    FROM ({FUNNEL_SQL.format(key="o_orderkey", name="o_orderkey")})""")
def dropped_rows_history(spark, sf_dir):
    name = f"{scratch_schema(spark, 'query')}.dropped_history"
    append_to_history(funnel_audit(order_funnel(spark, sf_dir), "o_orderkey"), name, "daily", "2024-03-01")
    return spark.table(name)


@query("""
    SELECT c.* FROM customer c LEFT JOIN (
      SELECT user_id FROM events WHERE event_type = 'error'
        AND ts BETWEEN DATE '2024-01-20' AND DATE '2024-02-01' GROUP BY 1) e ON c.c_custkey = e.user_id
    WHERE e.user_id IS NULL""")
def exclude_seen_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "c_custkey", "ts": "date_created"})
    return exclude_seen(table(spark, sf_dir, "customer"), events, "c_custkey",
                        seen_since("error", "2024-01-20", "2024-02-01", evid_column="event_type"))
