import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidescore.operators import CoverageError, read_wide, seen_since
from tidescore.plans import (
    Events,
    History,
    Model,
    Step,
    Wide,
    WorkFailed,
    run_chain,
    sql_frame,
    sql_step,
    store_results,
    update_work_list,
)
from tidescore.sources import shared_dir, table_exists


def model():
    def load():
        return lambda batch: pd.DataFrame({"p": batch["n"] * 0.5}, index=batch.index)[batch["n"] != 3]
    return load


def steps(threshold=80):
    return [
        Step("first", lambda df, least=0: df.filter(F.col("n") >= least)),
        Step("scored", model=Model("short", ["n"], model(), "p double", threshold)),
        sql_step("last", {"big": "SELECT * FROM {input} WHERE coalesce(p, 9) > :least"}, "big", least=1),
    ]


@pytest.fixture
def source(spark):
    return spark.range(10).select(F.col("id").alias("k"), F.col("id").cast("int").alias("n"))


def test_all_steps(spark, rows, source, schema):
    result = run_chain(spark, source, steps(), "k", execution_date="2024-01-01", dropped_history=f"{schema}.dropped")
    assert result.coverage["scored"].pct == 90.0
    assert rows(result.outputs["scored"].filter("p IS NULL")) == [(3, 3, None)]
    assert rows(result.outputs["last"].select("k")) == [(k,) for k in range(3, 10)]
    dropped = [(0, "last", 2.0), (1, "last", 2.0), (2, "last", 2.0), (3, "model_short", 1.0)]
    assert rows(result.dropped) == dropped
    assert rows(spark.table(f"{schema}.dropped").select("k", "drop_step", "priority")) == dropped
    tables = result.schema
    result.drop_temps()
    assert not table_exists(spark, f"{tables}.last")


def test_subset_and_overrides(spark, rows, source):
    result = run_chain(spark, source, steps(), "k", only=["first", "last"], overrides={
        "first": {"params": {"least": 5}},
        "last": {"build": "SELECT * FROM {input} WHERE n < :most", "params": {"most": 7}}})
    assert list(result.outputs) == ["first", "last"] and result.coverage == {}
    assert rows(result.dropped) == [(7, "last", 2.0), (8, "last", 2.0), (9, "last", 2.0)]
    result.drop_temps()


def test_inputs(spark, rows, source, schema):
    source.filter("k < 2").write.saveAsTable(f"{schema}.other")
    chain = [Step("a", lambda df: df.filter("k < 8")), Step("b", lambda df: df.filter("k < 4")),
             Step("c", input_step="a"), Step("d", input_table=f"{schema}.other")]
    result = run_chain(spark, source, chain, "k")
    assert [result.outputs[name].count() for name in "abcd"] == [8, 4, 8, 2]
    assert rows(result.dropped.groupBy("drop_step").count()) == [("b", 4), ("d", 6)]
    result.drop_temps()
    with pytest.raises(ValueError, match="has not run"):
        run_chain(spark, source, chain, "k", only=["c"])
    with pytest.raises(ValueError, match="unknown"):
        run_chain(spark, source, chain, "k", only=["z"])


def test_a_step_that_drops_nothing(spark, source):
    result = run_chain(spark, source, [Step("a"), Step("b")], "k")
    assert result.dropped.count() == 0
    assert run_chain(spark, source, [Step("a")], "k").dropped.count() == 0


def test_gate(spark, source):
    before = spark.catalog.listDatabases()
    with pytest.raises(CoverageError, match="9 of 10"):
        run_chain(spark, source, steps(threshold=91), "k")
    assert spark.catalog.listDatabases() == before


def test_model_forms(spark, rows, source, schema):
    source.select("k", (F.col("n") * 2).alias("p")).filter("k <> 4").write.saveAsTable(f"{schema}.predictions")
    source.write.saveAsTable(f"{schema}.source")
    chain = [Step("stored", model=Model("s", [], table=f"{schema}.predictions", threshold=90)),
             Step("plain", model=Model("p", ["n"], columns={"q": F.col("n") + 1})), Step("same")]
    result = run_chain(spark, f"{schema}.source", chain, "k")
    assert rows(result.outputs["same"].filter("k > 3 AND k < 6")) == [(4, 4, None, 5), (5, 5, 10, 6)]
    assert rows(result.dropped) == [(4, "model_s", 1.0)]
    assert result.coverage["stored"].output_count == 9 and result.coverage["plain"].pct == 100.0
    assert sorted(row.name for row in spark.catalog.listTables(result.schema)) == ["dropped_rows", "plain", "stored"]
    result.drop_temps()
    with pytest.raises(ValueError, match="one of"):
        Model("none", [])


def test_sql_templates(spark, source):
    with pytest.raises(ValueError, match="no SQL found"):
        sql_step("s", {"a": ""}, "a")
    with pytest.raises(ValueError, match="no SQL found"):
        sql_step("s", {"a": "SELECT 1"}, "b")
    with pytest.raises(ValueError, match="no value"):
        sql_frame(source, "SELECT * FROM {input} WHERE n > :least").collect()
    with pytest.raises(ValueError, match="no SQL given"):
        sql_frame(source, " ")


def test_store_results(spark, rows, source, schema):
    df = source.withColumn("execution_date", F.lit("2024-01-01"))
    created = F.lit("2024-01-03").cast("timestamp_ntz")
    seen = spark.createDataFrame([(1, 5)], "k bigint, evid int").withColumn("date_created", created)
    places = dict(
        history=History(f"{schema}.history", columns=["k", "execution_date"]),
        wide=Wide(f"{schema}.wide", select_fields=["k", "n", "execution_date"], buckets=2),
        events=Events(f"{schema}.events", f"{schema}.registry", 5, {
            "source_number": 7, "endpoint": "things", "priority": 2}, build=lambda rows: rows.filter("k < 4"),
                      seen=seen, where=seen_since(5, "2024-01-01"), limit=2))
    store_results(df, "k", "daily", store=False, **places)
    assert not table_exists(spark, f"{schema}.history")
    store_results(df, "k", "daily", **places)
    store_results(df.filter("k < 3"), "k", "daily", "2024-01-05", history=History(f"{schema}.history", columns=["k"]))
    assert spark.table(f"{schema}.history").count() == 13
    assert read_wide(spark, f"{schema}.wide").columns == ["k", "n", "execution_date", "date_updated"]
    assert spark.table(f"{schema}.events").count() == 2 and spark.table(f"{schema}.registry").count() == 1
    assert shared_dir(spark) in spark.sql(f"DESCRIBE SCHEMA {schema}").filter("info_name = 'Location'").first()[1]


def test_work_list(spark, rows, schema):
    name = f"{schema}.work_list"
    fields = "table_name string, enriched_table_name string"
    spark.createDataFrame([("a", None), ("b", "old"), ("c", None)], fields).write.saveAsTable(name)
    finished = spark.createDataFrame([("a", "new"), ("a", "new"), ("b", "new"), ("z", "new")], fields)
    with pytest.raises(WorkFailed):
        update_work_list(spark, name, finished, failed=True)
    expected = [("a", "new"), ("b", "old"), ("c", None)]
    assert rows(spark.table(name)) == expected
    assert rows(update_work_list(spark, name, finished.limit(0))) == expected
