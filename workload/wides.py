"""Newest-wins upserts of orders by customer."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidescore.operators import merge_into_wide, newest_per_key, read_wide, upsert_newest
from tidescore.sources import scratch_schema
from workload.registry import query, table

VALUES = ["custkey", "orderkey", "total", "execution_date"]


def customer_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"),
        F.col("o_totalprice").alias("total"), F.to_date("o_orderdate").alias("execution_date"))


def wide_and_delta(spark, sf_dir):
    """The second order by date of most customers, and the lowest-numbered order of the even ones."""
    orders = customer_orders(spark, sf_dir)
    by_date = Window.partitionBy("custkey").orderBy("execution_date", "orderkey")
    by_number = Window.partitionBy("custkey").orderBy("orderkey")
    wide = (orders.filter("custkey % 3 <> 0").withColumn("place", F.row_number().over(by_date))
            .filter("place = 2").select(*VALUES))
    delta = (orders.filter("custkey % 2 = 0").withColumn("place", F.row_number().over(by_number))
             .filter("place = 1").select(*VALUES))
    return wide, delta


SIDES = """
    WITH orders2 AS (SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_totalprice AS total,
                            CAST(o_orderdate AS DATE) AS execution_date FROM orders),
    w AS (SELECT custkey, orderkey, total, execution_date FROM (
            SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY execution_date, orderkey) AS place
            FROM orders2 WHERE custkey % 3 <> 0) WHERE place = 2),
    d AS (SELECT custkey, orderkey, total, execution_date FROM (
            SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY orderkey) AS place
            FROM orders2 WHERE custkey % 2 = 0) WHERE place = 1)"""

UPSERT_SQL = SIDES + """
    SELECT coalesce(w.custkey, d.custkey) AS custkey,
      CASE WHEN w.custkey IS NULL OR d.execution_date > w.execution_date THEN d.orderkey ELSE w.orderkey END AS orderkey,
      CASE WHEN w.custkey IS NULL OR d.execution_date > w.execution_date THEN d.total ELSE w.total END AS total,
      CASE WHEN w.custkey IS NULL OR d.execution_date > w.execution_date THEN d.execution_date
           ELSE w.execution_date END AS execution_date
    FROM w FULL JOIN d ON w.custkey = d.custkey"""


@query(UPSERT_SQL)
def upsert_newest_query(spark, sf_dir):
    wide, delta = wide_and_delta(spark, sf_dir)
    return upsert_newest(wide, delta, "custkey")


@query(SIDES + """,
    w2 AS (SELECT custkey, orderkey, total, CASE WHEN orderkey % 4 <> 0 THEN execution_date END AS first_date,
                  CASE WHEN orderkey % 5 <> 0 THEN execution_date END AS second_date FROM w),
    d2 AS (SELECT custkey, orderkey, total, CASE WHEN orderkey % 4 <> 0 THEN execution_date END AS first_date,
                  CASE WHEN orderkey % 5 <> 0 THEN execution_date END AS second_date FROM d),
    j AS (SELECT w2.custkey IS NULL OR coalesce(coalesce(d2.first_date, d2.second_date)
                 > coalesce(w2.first_date, w2.second_date), false) AS take,
                 coalesce(w2.custkey, d2.custkey) AS custkey,
                 w2.orderkey AS wo, w2.total AS wt, w2.first_date AS wf, w2.second_date AS ws,
                 d2.orderkey AS do_, d2.total AS dt, d2.first_date AS df, d2.second_date AS ds
          FROM w2 FULL JOIN d2 ON w2.custkey = d2.custkey)
    SELECT custkey, CASE WHEN take THEN do_ ELSE wo END AS orderkey, CASE WHEN take THEN dt ELSE wt END AS total,
           CASE WHEN take THEN df ELSE wf END AS first_date, CASE WHEN take THEN ds ELSE ws END AS second_date
    FROM j""")
def upsert_two_dates(spark, sf_dir):
    """The first non-null of two dates decides; without one on either side the old row stays."""
    sides = []
    for side in wide_and_delta(spark, sf_dir):
        date = F.col("execution_date")
        sides.append(side.select("custkey", "orderkey", "total",
                                 F.when(F.col("orderkey") % 4 != 0, date).alias("first_date"),
                                 F.when(F.col("orderkey") % 5 != 0, date).alias("second_date")))
    return upsert_newest(*sides, "custkey", "first_date,second_date")


NEWEST_SQL = """
    SELECT custkey, orderkey, total, execution_date FROM (
      SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_totalprice AS total,
             CAST(o_orderdate AS DATE) AS execution_date,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place
      FROM orders) WHERE place = 1"""


@query(NEWEST_SQL)
def newest_per_key_query(spark, sf_dir):
    return newest_per_key(customer_orders(spark, sf_dir), "custkey", "execution_date")


@query(NEWEST_SQL)
def upsert_repeated_delta(spark, sf_dir):
    """All orders as the delta, the newest of each customer counting."""
    wide, _ = wide_and_delta(spark, sf_dir)
    return upsert_newest(wide, customer_orders(spark, sf_dir), "custkey", on_duplicate="newest")


@query(UPSERT_SQL)
def merge_into_wide_query(spark, sf_dir):
    """Created, merged into, and merged into again with the same delta, which changes nothing."""
    name = f"{scratch_schema(spark, 'query')}.wide"
    wide, delta = wide_and_delta(spark, sf_dir)
    for rows in (wide, delta, delta):
        merge_into_wide(spark, name, rows, "custkey", select_fields=VALUES, buckets=8)
    return read_wide(spark, name)


@query(SIDES + """
    SELECT * FROM w UNION ALL
    SELECT d.* FROM d LEFT JOIN w ON d.custkey = w.custkey WHERE w.custkey IS NULL AND d.custkey % 10 = 0""")
def merge_into_wide_part(spark, sf_dir):
    """A delta of old dates for a tenth of the keys: only its new keys are added."""
    name = f"{scratch_schema(spark, 'query')}.wide"
    wide, delta = wide_and_delta(spark, sf_dir)
    merge_into_wide(spark, name, wide, "custkey", buckets=16)
    old = delta.filter("custkey % 10 = 0").join(wide.select("custkey", F.lit(True).alias("known")), "custkey", "left")
    early = F.when(F.col("known"), F.lit("1900-01-01").cast("date")).otherwise(F.col("execution_date"))
    merge_into_wide(spark, name, old.withColumn("execution_date", early).drop("known"), "custkey")
    return read_wide(spark, name)


@query("""
    SELECT o_orderkey AS k, upper(o_orderstatus) AS language, CAST(o_orderdate AS DATE) AS site_change_date
    FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL
    SELECT o_orderkey, 'new', CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 2 = 1 AND o_totalprice > 200000""")
def merge_into_wide_reshaped(spark, sf_dir):
    """Renamed columns and a date from text on the way into the table, written only once."""
    name = f"{scratch_schema(spark, 'query')}.wide"
    orders = table(spark, sf_dir, "orders").withColumn("revision_date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    shape = [F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("language"),
             F.to_date("revision_date").alias("site_change_date")]
    new = orders.filter("o_orderkey % 2 = 0 OR o_totalprice > 200000").withColumn("o_orderstatus", F.lit("new"))
    for rows in (orders.filter("o_orderkey % 2 = 0"), new):
        merge_into_wide(spark, name, rows, "k", "site_change_date", select_fields=shape, buckets=8, staged=False)
    return read_wide(spark, name)


@query("""
    SELECT lower(c_mktsegment) AS segment, max(c_custkey) AS custkey, DATE '2024-01-02' AS execution_date
    FROM customer GROUP BY 1""")
def merge_by_folded_key(spark, sf_dir):
    """Segments in capitals and in lower case are one key after folding; a narrower number is widened."""
    name = f"{scratch_schema(spark, 'query')}.wide"
    customers = table(spark, sf_dir, "customer")
    fields = [F.lower("c_mktsegment").alias("segment"), "custkey", "execution_date"]
    for day, text in (("2024-01-01", F.col("c_mktsegment")), ("2024-01-02", F.lower("c_mktsegment"))):
        rows = customers.groupBy(text.alias("c_mktsegment")).agg(F.max("c_custkey").alias("custkey"))
        rows = rows.withColumn("execution_date", F.lit(day).cast("date"))
        merge_into_wide(spark, name, rows, "segment", select_fields=fields, buckets=4)
    merge_into_wide(spark, name, spark.table(name).limit(0).withColumn("custkey", F.lit(1)), "segment")
    return read_wide(spark, name)
