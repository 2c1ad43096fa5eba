"""Creating, replacing, moving and dropping tables, and the event outbox."""

from pyspark.sql import functions as F

from tidescore.functions import add_date_updated
from tidescore.operators import events_to_write, seen_since, write_events
from tidescore.plans import sql_frame
from tidescore.sources import (
    create_table,
    create_table_with,
    drop_listed_tables,
    drop_tables,
    ensure_table,
    insert_rows,
    load,
    move_with_view,
    publish_table,
    replace_rows,
    scratch_schema,
    set_properties,
    store,
)
from tidescore.sources.tables import get_property
from workload.registry import query, table


@query("SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def create_table_from_sql(spark, sf_dir):
    schema = scratch_schema(spark, "query")
    store(table(spark, sf_dir, "orders"), f"{schema}.orders")
    return create_table(
        spark, f"SELECT o_custkey, count(*) AS n_orders FROM {schema}.orders WHERE o_totalprice > :least "
        "GROUP BY o_custkey", f"{schema}.counts", args={"least": 100000})


@query("SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def create_table_swap(spark, sf_dir):
    """The second query reads the table that it replaces."""
    name = f"{scratch_schema(spark, 'query')}.orders_kept"
    create_table(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), name)
    return create_table(spark, f"SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM {name} "
                        "WHERE o_orderstatus = 'O'", name, swap=True)


def revenue_by_flag(lines, least):
    revenue = F.col("l_quantity") * 2
    return lines.filter(F.col("l_quantity") >= least).groupBy("l_returnflag").agg(F.sum(revenue).alias("doubled"))


@query("SELECT l_returnflag, sum(l_quantity * 2) AS doubled FROM lineitem WHERE l_quantity >= 10 GROUP BY 1")
def create_table_from_function(spark, sf_dir):
    schema = scratch_schema(spark, "query")
    return create_table_with(spark, revenue_by_flag, f"{sf_dir}/lineitem.parquet", f"{schema}.by_flag", least=10)


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS priority FROM customer")
def ensure_and_insert(spark, sf_dir):
    """An empty table with a declared schema, made twice and filled by name; the int becomes a double."""
    name = f"{scratch_schema(spark, 'query')}.declared"
    for _ in range(2):
        ensure_table(spark, name, "c_custkey bigint, c_name string, priority double")
    insert_rows(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("priority"), "c_name", "c_custkey"),
                name)
    return load(spark, name)


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier")
def store_append(spark, sf_dir):
    name = f"{scratch_schema(spark, 'query')}.suppliers"
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    store(rows.filter("s_suppkey < 0"), name)
    store(rows, name)
    store(rows, name, "append")
    return load(spark, name)


@query("SELECT p_partkey, p_brand FROM part UNION ALL SELECT p_partkey, p_brand FROM part")
def moved_table_and_view(spark, sf_dir):
    schema = scratch_schema(spark, "query")
    create_table(spark, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), f"{schema}.parts")
    move_with_view(spark, f"{schema}.parts", f"{schema}.parts_moved")
    return load(spark, f"{schema}.parts").unionAll(load(spark, f"{schema}.parts_moved"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("""
    SELECT c_custkey, lower(c_mktsegment) AS segment, c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD') AS still_there
    FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')""")
def dropped_listed_tables(spark, sf_dir):
    """One table per segment; the work list names some of them, one pending, one that does not exist.

    Each customer comes with whether the table of the customer's segment is still in the catalog.
    """
    schema = scratch_schema(spark, "query")
    customers = table(spark, sf_dir, "customer")
    for segment in SEGMENTS:
        create_table(spark, customers.filter(F.col("c_mktsegment") == segment), f"{schema}.{segment}")
    work_list = customers.filter("c_mktsegment IN ('BUILDING', 'HOUSEHOLD')").select(
        F.concat(F.lit(f"{schema}."), "c_mktsegment").alias("table_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", f"{schema}.not_there").alias("enriched_table_name"))
    drop_listed_tables(spark, [work_list])
    drop_tables(spark, [f"{schema}.not_there_either", None])
    left = spark.sql(f"SHOW TABLES IN {schema}").select(F.col("tableName").alias("segment"), F.lit(True).alias("found"))
    listed = customers.filter(F.col("c_mktsegment").isin(*SEGMENTS)).select(
        "c_custkey", F.lower("c_mktsegment").alias("segment"))
    return listed.join(F.broadcast(left), "segment", "left").select(
        "c_custkey", "segment", F.coalesce("found", F.lit(False)).alias("still_there"))


@query("SELECT n_nationkey, n_name, 'merge-on-read' AS write_mode FROM nation")
def table_property(spark, sf_dir):
    """A table's rows, each with a property that was set on the table and read back."""
    name = f"{scratch_schema(spark, 'query')}.nations"
    store(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), name)
    set_properties(spark, name, {"write.mode": "copy-on-write"})
    set_properties(spark, name, {"write.mode": "merge-on-read"})
    shown = spark.sql(f"SHOW TBLPROPERTIES {name}").filter("key = 'write.mode'").select(F.col("value").alias("write_mode"))
    return load(spark, name).join(F.broadcast(shown))


@query("""
    SELECT r_regionkey, r_name, count(*) AS n_nations FROM region JOIN nation ON r_regionkey = n_regionkey
    WHERE r_regionkey IN (1, 3) GROUP BY ALL""")
def replaced_control_table(spark, sf_dir):
    """The regions that a small control table names after it was replaced, with their nations counted."""
    name = f"{scratch_schema(spark, 'query')}.control"
    for keys in ([(0,), (2,)], [(1,), (3,)]):
        replace_rows(spark, name, keys, "r_regionkey int")
    regions = table(spark, sf_dir, "region").join(load(spark, name), "r_regionkey")
    nations = table(spark, sf_dir, "nation")
    return (regions.join(nations, regions.r_regionkey == nations.n_regionkey)
            .groupBy("r_regionkey", "r_name").agg(F.count(F.lit(1)).alias("n_nations")))


@query("SELECT o_orderkey, o_orderstatus, 'merge-on-read' AS write_mode FROM orders")
def table_property_of_orders(spark, sf_dir):
    """The orders of a stored table, each with a property of the table, which a constant carries."""
    name = f"{scratch_schema(spark, 'query')}.orders"
    store(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), name)
    set_properties(spark, name, {"write.mode": "copy-on-write"})
    set_properties(spark, name, {"write.mode": "merge-on-read"})
    return load(spark, name).withColumn("write_mode", F.lit(get_property(spark, name, "write.mode")))


@query("""
    SELECT o_orderpriority, count(*) AS n_orders, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders
    WHERE o_orderstatus IN ('F', 'P') GROUP BY ALL""")
def orders_by_control_table(spark, sf_dir):
    """The orders that a small control table chooses after it was replaced."""
    name = f"{scratch_schema(spark, 'query')}.control"
    for keys in ([("O",)], [("F",), ("P",)]):
        replace_rows(spark, name, keys, "o_orderstatus string")
    chosen = table(spark, sf_dir, "orders").join(F.broadcast(load(spark, name)), "o_orderstatus", "left_semi")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return chosen.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(cents).alias("cents"))


@query("""
    SELECT o_orderkey, o_totalprice * 4 AS o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000""")
def published_orders(spark, sf_dir):
    """A published table, replaced three times by what reads it."""
    name = f"{scratch_schema(spark, 'query')}.orders"
    publish_table(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), name)
    publish_table(spark, f"SELECT * FROM {name} WHERE o_orderstatus = :status", name, args={"status": "O"})
    publish_table(spark, f"SELECT * FROM {name} WHERE o_totalprice > 1000", name)
    return publish_table(spark, f"SELECT o_orderkey, o_totalprice * 4 AS o_totalprice, o_orderstatus FROM {name}", name)


@query("""
    SELECT 7 AS source_number, 1511 AS evid, 3 AS priority, 'customers' AS endpoint, true AS drop_table,
           TIMESTAMP '2024-03-01 12:00:00' AS date_created, c_custkey FROM customer
    WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error'
                            AND ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-02-01')""")
def announced_once(spark, sf_dir):
    """Events written by one run that is tried three times, each event with the announcement of its table."""
    schema = scratch_schema(spark, "query")
    seen, where = unseen_customers(spark, sf_dir)
    rows = events_to_write(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", seen, where)
    for _ in range(3):
        write_events(rows, f"{schema}.unseen", f"{schema}.registry", 1511, source_number=7, endpoint="customers",
                     priority=3, now="2024-03-01 12:00:00", run="2024-03-01")
    events = load(spark, f"{schema}.unseen").withColumn("table_name", F.lit(f"{schema}.unseen"))
    return events.join(F.broadcast(load(spark, f"{schema}.registry")), "table_name").drop("table_name")


@query("""
    SELECT c_custkey, TIMESTAMP '2024-03-01 08:30:00' AS date_updated FROM customer
    WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10')""")
def stamped_and_unseen(spark, sf_dir):
    """The update time fixed, and the events window open to its default end, tomorrow."""
    purchases = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "c_custkey", "ts": "date_created"})
    rows = events_to_write(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", purchases,
                           seen_since("purchase", "2024-01-10", evid_column="event_type"))
    stamped = add_date_updated(add_date_updated(rows, "2024-03-01 08:30:00"), "2030-01-01 00:00:00")
    return stamped.withColumn("date_updated", F.col("date_updated").cast("timestamp_ntz"))


@query("""
    SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents
    WHERE n_chars > 200 AND lang <> 'fr' GROUP BY lang""")
def sql_with_parameters(spark, sf_dir):
    return sql_frame(table(spark, sf_dir, "documents"),
                     "SELECT lang, count(*) AS n_docs, sum(n_chars) AS chars FROM {input} "
                     "WHERE n_chars > :least AND lang <> :without GROUP BY lang",
                     {"least": 200, "without": "fr"})


def unseen_customers(spark, sf_dir):
    seen = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "c_custkey", "ts": "date_created"})
    where = seen_since("error", "2024-01-20", "2024-02-01", evid_column="event_type")
    return seen, where


UNSEEN_SQL = """
    SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (
      SELECT user_id FROM events WHERE event_type = 'error'
        AND ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-02-01')"""


@query(UNSEEN_SQL)
def events_to_write_query(spark, sf_dir):
    seen, where = unseen_customers(spark, sf_dir)
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return events_to_write(source, "c_custkey", seen, where)


@query(f"""
    SELECT 'unseen' AS events_table, 'customers' AS endpoint, 7 AS source_number, 1511 AS evid,
           true AS drop_table, 3 AS priority, TIMESTAMP '2024-03-01 12:00:00' AS date_created,
           (SELECT count(*) FROM ({UNSEEN_SQL})) AS n_events
    UNION ALL
    SELECT 'all_customers', 'customers', 7, 1512, true, 3, TIMESTAMP '2024-03-01 12:00:00', (SELECT count(*) FROM customer)""")
def outbox_registry(spark, sf_dir):
    """Two events tables written and announced; each registry row with its table's row count."""
    schema = scratch_schema(spark, "query")
    registry = f"{schema}.registry"
    seen, where = unseen_customers(spark, sf_dir)
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    for name, rows, evid in (("unseen", events_to_write(source, "c_custkey", seen, where), 1511),
                             ("all_customers", events_to_write(source, "c_custkey"), 1512)):
        write_events(rows, f"{schema}.{name}", registry, evid, source_number=7, endpoint="customers", priority=3,
                     now="2024-03-01 12:00:00")
    counts = [load(spark, f"{schema}.{name}").agg(F.count(F.lit(1)).alias("n_events"))
              .select(F.lit(f"{schema}.{name}").alias("table_name"), "n_events")
              for name in ("unseen", "all_customers")]
    registered = load(spark, registry).join(counts[0].unionAll(counts[1]), "table_name")
    return registered.withColumn("events_table", F.substring_index("table_name", ".", -1)).drop("table_name")
