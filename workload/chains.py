"""Whole runs: one result into several places, and chains of steps."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tidescore.operators import read_wide, seen_since
from tidescore.plans import Events, History, Model, Step, Wide, run_chain, sql_step, store_results
from tidescore.sources import scratch_schema
from workload.registry import query, table

RUN_DATE = dt.date(2024, 3, 1)


@query("""
    SELECT 'history' AS place, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS execution_date FROM orders
    UNION ALL SELECT 'wide', o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) FROM orders
      WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'events', o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) FROM orders
      WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'click')""")
def store_results_query(spark, sf_dir):
    """The rows of every place, under the orders' own dates."""
    schema = scratch_schema(spark, "query")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("execution_date"))
    clicks = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("o_orderkey"), "event_type", F.col("ts").alias("date_created"))
    history = History(f"{schema}.history")
    wide = Wide(f"{schema}.wide", buckets=8)
    events = Events(f"{schema}.events", f"{schema}.registry", 1511,
                    {"source_number": 7, "endpoint": "orders", "priority": 3},
                    build=lambda rows: rows.filter("o_orderstatus = 'O'"), seen=clicks,
                    where=seen_since("click", "2024-01-01", "2024-02-01", evid_column="event_type"))
    finished = orders.filter("o_orderstatus <> 'P'")
    store_results(finished, "o_orderkey", "daily", history=history, wide=wide, events=events)
    store_results(orders.filter("o_orderstatus = 'P'"), "o_orderkey", "daily", history=history)
    store_results(orders, "o_orderkey", "daily", history=history, wide=wide, store=False)
    places = [("history", spark.table(history.table)), ("wide", read_wide(spark, wide.table)),
              ("events", spark.table(events.table))]
    rows = [found.select(F.lit(place).alias("place"), *orders.columns) for place, found in places]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


def partial_model():
    """Scores texts by length and gives no prediction for very short ones."""
    def load():
        def predict(batch: pd.DataFrame) -> pd.DataFrame:
            known = batch[batch["n_chars"] >= 30]
            return pd.DataFrame({"length_score": (known["n_chars"] % 100) / 100.0}, index=known.index)
        return predict
    return load


TEMPLATES = {
    "confident": "SELECT * FROM {input} WHERE length_score >= :least OR length_score IS NULL",
    "english": "SELECT * FROM {input} WHERE lang = 'en'",
}


def document_steps(schema):
    model = Model("length", ["lang", "n_chars"], partial_model(), "length_score double", threshold=90)
    wide = Wide(f"{schema}.wide", select_fields=["doc_id", "lang", "length_score", "execution_date"],
                date_updated=False, buckets=8)
    return [
        Step("known_sources", lambda rows: rows.filter("source <> 'src19'")),
        Step("scored", model=model, wide=wide, history=History(
            f"{schema}.history", columns=["doc_id", "lang", "length_score"], nulls={"remark": "string"})),
        sql_step("confident", TEMPLATES, "confident", least=0.2),
        sql_step("english", TEMPLATES, "english"),
    ]


def document_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.lit(RUN_DATE).alias("execution_date"))


def document_chain(spark, sf_dir, **options):
    schema = scratch_schema(spark, "query")
    result = run_chain(spark, document_source(spark, sf_dir), document_steps(schema), "doc_id",
                       run_type="daily", execution_date="2024-03-01",
                       dropped_history=f"{schema}.dropped_history", **options)
    return schema, result


KNOWN = "SELECT * FROM documents WHERE source <> 'src19'"
SCORED = f"""
    SELECT doc_id, lang, source, n_chars, DATE '2024-03-01' AS execution_date,
           CASE WHEN n_chars >= 30 THEN CAST(n_chars % 100 AS DOUBLE) / 100 END AS length_score
    FROM ({KNOWN})"""
CONFIDENT = f"SELECT * FROM ({SCORED}) WHERE length_score >= 0.2 OR length_score IS NULL"
DROPPED_SQL = f"""
    SELECT doc_id, 'model_length' AS drop_step, CAST(1 AS DOUBLE) AS priority FROM ({KNOWN}) WHERE n_chars < 30
    UNION ALL SELECT doc_id, 'confident', 2 FROM ({SCORED}) WHERE doc_id NOT IN (SELECT doc_id FROM ({CONFIDENT}))
    UNION ALL SELECT doc_id, 'english', 2 FROM ({CONFIDENT}) WHERE lang <> 'en'"""


@query(f"SELECT * FROM ({CONFIDENT}) WHERE lang = 'en'")
def scoring_chain(spark, sf_dir):
    return document_chain(spark, sf_dir)[1].outputs["english"]


@query(f"""SELECT doc_id, drop_step, priority, 'daily' AS run_type, DATE '2024-03-01' AS execution_date
           FROM ({DROPPED_SQL})""")
def scoring_chain_dropped(spark, sf_dir):
    schema, _ = document_chain(spark, sf_dir)
    return spark.table(f"{schema}.dropped_history")


@query(f"""
    SELECT h.doc_id, h.lang, h.length_score, CAST(NULL AS VARCHAR) AS remark, 'daily' AS run_type,
           h.execution_date, w.length_score AS wide_score
    FROM ({SCORED}) h JOIN ({SCORED}) w ON h.doc_id = w.doc_id""")
def scoring_chain_stored(spark, sf_dir):
    """The history of the scored step, next to the score that the wide table holds."""
    schema, _ = document_chain(spark, sf_dir)
    wide = read_wide(spark, f"{schema}.wide").select("doc_id", F.col("length_score").alias("wide_score"))
    return spark.table(f"{schema}.history").join(wide, "doc_id")


@query(f"""
    SELECT doc_id, drop_step, priority FROM (
      SELECT doc_id, 'model_length' AS drop_step, CAST(1 AS DOUBLE) AS priority FROM documents WHERE n_chars < 30
      UNION ALL
      SELECT doc_id, 'confident', 2 FROM documents WHERE n_chars >= 30 AND n_chars % 100 < 50)""")
def scoring_chain_backfill(spark, sf_dir):
    """Only two of the steps, one with another parameter, and without storing."""
    _, result = document_chain(spark, sf_dir, only=["scored", "confident"], store=False,
                               overrides={"confident": {"params": {"least": 0.5}}})
    return result.dropped


@query("""
    SELECT doc_id, lang, quality, toxic, drop_step FROM documents LEFT JOIN labels USING (doc_id)
    LEFT JOIN (SELECT d.doc_id, 'model_labels' AS drop_step FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id)
      USING (doc_id)""")
def chain_with_stored_predictions(spark, sf_dir):
    """The labels as stored predictions of the documents, next to what the check recorded as dropped."""
    model = Model("labels", [], table=f"{sf_dir}/labels.parquet", threshold=20)
    result = run_chain(spark, f"{sf_dir}/documents.parquet", [Step("labelled", model=model)], "doc_id")
    labelled = result.outputs["labelled"].select("doc_id", "lang", "quality", "toxic")
    return labelled.join(result.dropped.select("doc_id", "drop_step"), "doc_id", "left")


@query("""
    SELECT doc_id, lang, n_chars, CAST(n_chars AS DOUBLE) / 10 AS tenth, lang <> 'en' AS foreign_language FROM documents""")
def chain_with_column_model(spark, sf_dir):
    """A model of expressions; a second step without a build or a model hands its input on."""
    model = Model("tenths", ["lang", "n_chars"], columns={
        "tenth": F.col("n_chars") / 10, "foreign_language": F.col("lang") != "en"})
    steps = [Step("scored", lambda rows: rows.select("doc_id", "lang", "n_chars"), model=model), Step("same")]
    return run_chain(spark, f"{sf_dir}/documents.parquet", steps, "doc_id").outputs["same"]


class StoppedError(Exception):
    """Stands for a driver that is lost."""


@query(f"""
    SELECT 'output' AS part, doc_id, CAST(NULL AS VARCHAR) AS drop_step FROM ({CONFIDENT}) WHERE lang = 'en'
    UNION ALL SELECT 'history', doc_id, NULL FROM ({SCORED})
    UNION ALL SELECT 'wide', doc_id, NULL FROM ({SCORED})
    UNION ALL SELECT 'dropped', doc_id, drop_step FROM ({DROPPED_SQL})""")
def resumed_chain(spark, sf_dir):
    """A run that is lost in its third step, goes on, and is called once more: every place has each result once."""
    schema = scratch_schema(spark, "query")
    calls = []

    def confident(rows, least):
        calls.append(least)
        if len(calls) == 1:
            raise StoppedError
        return rows.filter((F.col("length_score") >= least) | F.col("length_score").isNull())

    steps = document_steps(schema)
    steps[2] = Step("confident", confident, {"least": 0.2})
    source = f"{schema}.documents"
    document_source(spark, sf_dir).write.saveAsTable(source)
    for _ in range(3):
        try:
            result = run_chain(spark, source, steps, "doc_id", run_type="daily", execution_date="2024-03-01",
                               dropped_history=f"{schema}.dropped_history", resume=f"{schema}_run")
        except StoppedError:
            continue
    parts = [("output", result.outputs["english"]), ("history", spark.table(f"{schema}.history")),
             ("wide", read_wide(spark, f"{schema}.wide")), ("dropped", spark.table(f"{schema}.dropped_history"))]
    frames = [found.select(F.lit(part).alias("part"), "doc_id", F.col("drop_step") if part == "dropped"
                           else F.lit(None).cast("string").alias("drop_step")) for part, found in parts]
    return frames[0].unionAll(frames[1]).unionAll(frames[2]).unionAll(frames[3])
