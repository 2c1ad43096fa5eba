import pytest
from pyspark.sql import functions as F

from tidescore.operators import CoverageError, require_coverage, stored_coverage
from tidescore.plans import Model, Step, run_chain
from tidescore.plans import steps as steps_module
from tidescore.sources import count_rows, count_stored, store


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def wide_rows(spark):
    return spark.range(1000, numPartitions=7).select("id", (F.col("id") % 5).alias("part"), F.uuid().alias("text"))


def test_the_count_of_a_table_is_pushed(spark, wide_rows, schema):
    store(wide_rows, f"{schema}.plain")
    found = count_stored(spark, f"{schema}.plain")
    plan = plan_of(found)
    assert "PushedAggregation: [COUNT(*)]" in plan and "text" not in plan
    assert found.collect() == [(1000,)] and count_rows(spark, f"{schema}.plain") == 1000
    store(wide_rows.limit(10), f"{schema}.plain", "append")
    assert count_rows(spark, f"{schema}.plain") == 1010


def test_the_callers_settings_stay(spark, wide_rows, schema):
    store(wide_rows, f"{schema}.plain")
    names = ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")
    before = [spark.conf.get(name) for name in names]
    assert count_rows(spark, f"{schema}.plain") == 1000
    assert [spark.conf.get(name) for name in names] == before


def test_paths_also_of_partitions(spark, wide_rows, tmp_path):
    path = str(tmp_path / "rows")
    store(wide_rows, path, partition_by="part")
    found = count_stored(spark, path)
    assert "PushedAggregation: [COUNT(*)]" in plan_of(found) and found.first().n == 1000


def test_what_only_its_reader_can_count(spark, wide_rows, schema, tmp_path):
    """A partition elsewhere, a view, a folder left by a dropped partition, and another format."""
    store(wide_rows, f"{schema}.by_part", partition_by="part")
    store(spark.range(3).select("id", F.lit("x").alias("text")), str(tmp_path / "other"))
    spark.sql(f"ALTER TABLE {schema}.by_part ADD PARTITION (part = 9) LOCATION '{tmp_path / 'other'}'")
    assert count_rows(spark, f"{schema}.by_part") == 1003
    spark.sql(f"CREATE VIEW {schema}.some AS SELECT * FROM {schema}.by_part WHERE part = 9")
    assert count_rows(spark, f"{schema}.some") == 3
    wide_rows.limit(4).createOrReplaceTempView("counted_rows")
    assert count_rows(spark, "counted_rows") == 4
    spark.catalog.dropTempView("counted_rows")
    wide_rows.limit(6).write.format("json").saveAsTable(f"{schema}.lines")
    assert count_rows(spark, f"{schema}.lines") == 6


def test_empty_tables_and_odd_names(spark, schema):
    spark.sql(f"CREATE TABLE {schema}.empty (k int) USING parquet")
    assert count_rows(spark, f"{schema}.empty") == 0
    store(spark.range(2).toDF("Type").withColumn("Location", F.lit("a")).withColumn("n", F.lit(1)), f"{schema}.odd")
    assert count_rows(spark, f"{schema}.odd") == 2


def test_coverage_of_tables_and_frames(spark, schema):
    store(spark.range(100), f"{schema}.kernel")
    store(spark.range(98), f"{schema}.output")
    for kernel in (f"{schema}.kernel", spark.range(100)):
        for output in (f"{schema}.output", spark.range(98)):
            assert stored_coverage(spark, kernel, output, 98).collect() == [(100, 98, 98.0, True)]
            assert not stored_coverage(spark, kernel, output).first().passed
    assert stored_coverage(spark, spark.range(0), f"{schema}.output").collect() == [(0, 98, None, False)]


def test_a_chain_counts_its_tables_by_name(spark, schema, monkeypatch):
    asked = []

    def noted(kernel, output, *rest):
        asked.append((kernel, output))
        return require_coverage(kernel, output, *rest)

    monkeypatch.setattr(steps_module, "require_coverage", noted)
    store(spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("n")), f"{schema}.source")
    store(spark.range(9).select(F.col("id").alias("k"), F.lit(1.0).alias("p")), f"{schema}.predictions")
    chain = [Step("first", model=Model("stored", ["n"], table=f"{schema}.predictions", threshold=90)),
             Step("second", "SELECT k, n FROM {input}", input_step="first"),
             Step("third", model=Model("again", ["n"], table=f"{schema}.predictions", threshold=90)),
             Step("fourth", input_step="first", model=Model("more", ["n", "p"], table=f"{schema}.predictions", threshold=90))]
    result = run_chain(spark, f"{schema}.source", chain, "k", execution_date="2024-01-01")
    predictions = f"{schema}.predictions"
    assert asked == [(f"{schema}.source", predictions), (f"{result.schema}.second", predictions),
                     (f"{result.schema}.first", predictions)]
    assert [result.coverage[name].pct for name in ("first", "third", "fourth")] == [90.0] * 3
    result.drop_temps()
    with pytest.raises(CoverageError, match="again: 9 of 10"):
        run_chain(spark, f"{schema}.source", chain, "k", execution_date="2024-01-01",
                  overrides={"third": {"model": Model("again", ["n"], table=predictions, threshold=91)}})
