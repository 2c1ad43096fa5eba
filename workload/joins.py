"""Projection, scoring, joins, set operations and the latest-before lookup."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidescore.functions import cap_rows, inline_rows, nullify, pending, project_features, stack_distinct
from tidescore.operators import (
    anti_join,
    enrich_features,
    fill_missing,
    join_result,
    left_join,
    score,
    score_with_columns,
    snapshot_max_ts,
)
from tidescore.plans import update_work_list
from tidescore.sources import create_table, scratch_schema
from workload.registry import query, table


@query("SELECT doc_id, lang, n_chars FROM documents")
def project_features_query(spark, sf_dir):
    return project_features(table(spark, sf_dir, "documents"), "doc_id", "doc_id,lang,n_chars")


def length_model():
    """A stand-in model: a score from the text's length and language.

    The loader is a local function, so it travels to the executors with the job.
    """
    def load():
        def predict(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({
                "length_score": (batch["n_chars"] % 7) / 7.0,
                "is_english": (batch["lang"] == "en").astype("int32"),
            }, index=batch.index)
        return predict
    return load


LENGTH_PREDICTIONS = "length_score double, is_english int"
LENGTH_SQL = """
    SELECT doc_id, lang, n_chars, CAST(n_chars % 7 AS DOUBLE) / 7 AS length_score,
           CAST(lang = 'en' AS INTEGER) AS is_english
    FROM documents"""


@query(LENGTH_SQL)
def score_batches(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), "doc_id", "lang,n_chars", length_model(),
                 LENGTH_PREDICTIONS)


def doubling_model():
    def load():
        def predict(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"doubled": batch["amount"] * 2}, index=batch.index)
        return predict
    return load


@query("""
    SELECT nullif(doc_id, 3) + 9007199254740992 AS key, nullif(n_chars, 100) + 9007199254740993 AS amount,
           (nullif(n_chars, 100) + 9007199254740993) * 2 AS doubled
    FROM documents""")
def score_wide_numbers(spark, sf_dir):
    """Keys and features that a double cannot hold, some of them null."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "nullif(doc_id, 3) + 9007199254740992 AS key", "nullif(n_chars, 100) + 9007199254740993 AS amount")
    return score(rows, "key", "amount", doubling_model(), "doubled bigint")


@query("""
    SELECT ts, event_id AS amount, event_id * 2 AS doubled FROM events""")
def score_by_time(spark, sf_dir):
    """A timestamp as the key."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("amount"))
    scored = score(rows, "ts", "amount", doubling_model(), "doubled bigint")
    return scored.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
    SELECT l_orderkey, l_linenumber, n_orders FROM lineitem LEFT JOIN
      (SELECT o_custkey AS l_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n_orders FROM orders)
      USING (l_orderkey)""")
def left_join_split(spark, sf_dir):
    """Customers' numbers as order numbers, each repeated; the keys with many rows are joined apart."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    several = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("l_orderkey"), F.count(F.lit(1)).over(
        Window.partitionBy("o_custkey")).alias("n_orders"))
    return left_join(lines, several, "l_orderkey", max_key_rows=10, broadcast=False)


@query("""
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)""")
def anti_join_large(spark, sf_dir):
    """No count of the right side is given, so its distinct keys are stored and both sides are shuffled."""
    heavy = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return anti_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), heavy, "o_orderkey")


@query(LENGTH_SQL)
def score_columns(spark, sf_dir):
    return score_with_columns(table(spark, sf_dir, "documents"), "doc_id", "lang,n_chars", {
        "length_score": (F.col("n_chars") % 7).cast("double") / 7,
        "is_english": (F.col("lang") == "en").cast("int"),
    })


def labels_as_predictions(spark, sf_dir):
    """The labels with the model's features in them, as a model returns them."""
    return table(spark, sf_dir, "labels").withColumns({"lang": F.lit("?"), "n_chars": F.lit(0)})


JOIN_SQL = """
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


@query(JOIN_SQL)
def join_result_query(spark, sf_dir):
    return join_result(table(spark, sf_dir, "documents"), labels_as_predictions(spark, sf_dir), "doc_id",
                       "lang,n_chars,not_there")


@query(JOIN_SQL)
def join_result_shuffled(spark, sf_dir):
    return join_result(table(spark, sf_dir, "documents"), labels_as_predictions(spark, sf_dir), "doc_id",
                       "lang,n_chars", broadcast=False)


@query("""
    SELECT n.n_nationkey, n.n_name, c.c_custkey, c.c_acctbal
    FROM nation n LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 7) c
      ON n.n_nationkey = c.c_nationkey""")
def join_result_repeated(spark, sf_dir):
    """Many predictions per kernel row, more of them than a key may have before it is split."""
    customers = (table(spark, sf_dir, "customer").filter("c_nationkey <> 7")
                 .select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return join_result(nations, customers, "n_nationkey", max_key_rows=50, broadcast=False)


def documents_without_french(spark, sf_dir):
    lang = F.when(F.col("lang") != "fr", F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", lang.alias("lang"), "source")


def languages_from_labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.format_string("q%d", "quality").alias("lang"))


FILL_SQL = """
    SELECT d.doc_id, coalesce(nullif(d.lang, 'fr'), 'q' || CAST(l.quality AS VARCHAR)) AS lang, d.source
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


@query(FILL_SQL)
def fill_missing_query(spark, sf_dir):
    return fill_missing(documents_without_french(spark, sf_dir), languages_from_labels(spark, sf_dir),
                        "doc_id", "lang")


@query(f"SELECT * FROM ({FILL_SQL}) WHERE lang IS NULL")
def pending_rows(spark, sf_dir):
    filled = fill_missing(documents_without_french(spark, sf_dir), languages_from_labels(spark, sf_dir),
                          "doc_id", "lang")
    return pending(filled, "lang")


@query("""
    SELECT s.c_mktsegment AS table_name, d.enriched_table_name, s.n_rows
    FROM (SELECT c_mktsegment, count(*) AS n_rows FROM customer GROUP BY 1) s
    LEFT JOIN (VALUES ('BUILDING', 'enriched_building'), ('HOUSEHOLD', 'enriched_household'))
      AS d(table_name, enriched_table_name) ON s.c_mktsegment = d.table_name""")
def work_list_update(spark, sf_dir):
    """Finished jobs fill the work list, and the list is replaced by a query that reads it."""
    schema = scratch_schema(spark, "query")
    listed = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("table_name")).agg(
        F.lit(None).cast("string").alias("enriched_table_name"), F.count(F.lit(1)).alias("n_rows"))
    create_table(spark, listed, f"{schema}.work_list")
    finished = inline_rows(spark, [("BUILDING", "enriched_building"), ("HOUSEHOLD", "enriched_household"),
                                   ("BUILDING", "enriched_building"), ("GONE", "enriched_gone")],
                           "table_name string, enriched_table_name string")
    return update_work_list(spark, f"{schema}.work_list", finished)


@query("SELECT l_partkey AS k FROM lineitem UNION SELECT l_suppkey FROM lineitem UNION SELECT c_custkey FROM customer")
def stack_distinct_query(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l_partkey"),
                                                        F.col("c_custkey").alias("l_suppkey"))
    return stack_distinct([table(spark, sf_dir, "lineitem"), customers], ["l_partkey", "l_suppkey"], "k")


def purchases_and_clicks(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select(
        "user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return purchases, clicks


ENRICH_SQL = """
    WITH clicks AS (
      SELECT user_id, ts, click_id, click_value FROM (
        SELECT user_id, ts, event_id AS click_id, value AS click_value,
               row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS place
        FROM events WHERE event_type = 'click' {min_date}) WHERE place = 1)
    SELECT p.event_id, p.user_id, p.ts, c.click_id, c.click_value
    FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN clicks c ON p.user_id = c.user_id AND p.ts >= c.ts"""


@query(ENRICH_SQL.format(min_date=""))
def enrich_features_query(spark, sf_dir):
    purchases, clicks = purchases_and_clicks(spark, sf_dir)
    return enrich_features(purchases, clicks, "user_id", "click_id,click_value", "ts")


@query(ENRICH_SQL.format(min_date="AND ts >= DATE '2024-01-10'"))
def enrich_features_since(spark, sf_dir):
    """Backfill: feature rows before a date do not count."""
    purchases, clicks = purchases_and_clicks(spark, sf_dir)
    return enrich_features(purchases, clicks, "user_id", "click_id,click_value", "ts", min_date="2024-01-10")


@query(ENRICH_SQL.format(min_date=""))
def enrich_features_long_keys(spark, sf_dir):
    """The same with a low limit per key, so that most users are cut into time ranges."""
    purchases, clicks = purchases_and_clicks(spark, sf_dir)
    return enrich_features(purchases, clicks, "user_id", "click_id,click_value", "ts", max_key_rows=25)


@query("""
    SELECT o_orderkey, o_custkey, o_orderdate, event_id, value FROM (
      SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey % 7 = 3 AND o_orderstatus = 'P') o
    ASOF LEFT JOIN (
      SELECT user_id, seen_at, event_id, value FROM (
        SELECT user_id % 1500 AS user_id, ts - INTERVAL 10950 DAY AS seen_at, event_id, value,
               row_number() OVER (PARTITION BY user_id % 1500, ts ORDER BY event_id DESC) AS place FROM events) WHERE place = 1) e
    ON o.o_custkey = e.user_id AND o.o_orderdate >= e.seen_at""")
def enrich_features_of_few_keys(spark, sf_dir):
    """A kernel that counts as too large for a broadcast: events of other customers go by the bitmap of its keys."""
    kernel = table(spark, sf_dir, "orders").filter("o_custkey % 7 = 3 AND o_orderstatus = 'P'").select(
        "o_orderkey", "o_custkey", "o_orderdate")
    facts = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 1500).alias("o_custkey"), F.expr("ts - INTERVAL '10950' DAY").alias("at"), "event_id", "value")
    return enrich_features(kernel, facts, "o_custkey", "event_id,value", "o_orderdate", "at", max_broadcast_bytes=0)


@query("""
    SELECT max(make_timestamp(epoch_ms(ts) * 1000)) AS max_ts FROM events
    WHERE CAST(ts AS DATE) = DATE '2024-01-15'""")
def snapshot_max_ts_query(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(ms.alias("revision_ms"),
                                                 F.to_date("ts").alias("partition_date"))
    return snapshot_max_ts(rows, "2024-01-15", "revision_ms")


@query("""
    SELECT conv_id, turn, nullif(role, 'user') AS role,
           CASE WHEN turn % 3 <> 0 THEN text END AS text
    FROM conversations""")
def nullify_query(spark, sf_dir):
    """Texts and roles are blanked first, as empty strings and as spaces."""
    rows = table(spark, sf_dir, "conversations")
    return nullify(rows.withColumns({
        "role": F.when(F.col("role") == "user", "").otherwise(F.col("role")),
        "text": F.when(F.col("turn") % 3 == 0, "   ").otherwise(F.col("text")),
    }))


@query("""
    SELECT -1 AS cap, count(*) AS n_rows FROM orders
    UNION ALL SELECT 0, 0 UNION ALL SELECT 5, least(5, count(*)) FROM orders""")
def cap_rows_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    counts = [cap_rows(orders, cap).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(cap).alias("cap"), "n_rows")
              for cap in (-1, 0, 5)]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])
