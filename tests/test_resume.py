"""Runs that break off and go on: nothing is done twice, and every place takes each result once."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidescore.operators import read_wide
from tidescore.plans import ChangedStepError, Events, History, Model, Step, Wide, run_chain
from tidescore.plans import manifest as manifest_module
from tidescore.plans import steps as steps_module
from tidescore.plans.manifest import Manifest
from tidescore.sources import drop_schema


class Broken(Exception):
    pass


def half():
    def load():
        return lambda batch: pd.DataFrame({"p": batch["n"] * 0.5}, index=batch.index)[batch["n"] != 3]
    return load


def chain(schema, least=1):
    return [
        Step("first", lambda df, least: df.filter(F.col("n") >= least), {"least": least}, history=History(f"{schema}.first_history")),
        Step("scored", model=Model("short", ["n"], half(), "p double", 80), history=History(f"{schema}.history"),
             wide=Wide(f"{schema}.wide", buckets=2, now="2024-05-01 00:00:00"),
             events=Events(f"{schema}.events", f"{schema}.registry", 5, {"source_number": 7, "endpoint": "e", "priority": 1})),
        Step("last", "SELECT * FROM {input} WHERE n < 8"),
    ]


def run(spark, schema, source, **options):
    return run_chain(spark, source, chain(schema, **options), "k", execution_date="2024-01-01",
                     dropped_history=f"{schema}.dropped_history", resume=f"{schema}_run")


@pytest.fixture
def source(spark, schema):
    rows = spark.range(10).select(F.col("id").alias("k"), F.col("id").cast("int").alias("n"),
                                  F.lit("2024-01-01").cast("date").alias("execution_date"))
    rows.unionAll(rows.limit(1).select(F.lit(None).cast("bigint"), F.lit(9), "execution_date")).write.saveAsTable(f"{schema}.source")
    yield f"{schema}.source"
    drop_schema(spark, f"{schema}_run")


PARTS = ["first", "first__stored", "scored__scored", "scored__coverage", "scored", "scored__stored", "last", "last__stored",
         "dropped_rows", "dropped_history"]


def places(spark, rows, schema):
    return [rows(spark.table(f"{schema}.{name}").select("k")) for name in ("first_history", "history", "events")] + [
        rows(read_wide(spark, f"{schema}.wide").select("k")), spark.table(f"{schema}.registry").count(),
        rows(spark.table(f"{schema}.dropped_history").select("k", "drop_step"))]


@pytest.mark.parametrize("when", ["before", "after"])
def test_breaks_at_each_part(spark, rows, schema, source, monkeypatch, when):
    """The run breaks off once at each part, before it begins or after its work and before it is written down."""
    done, wanted = [], list(PARTS)
    plain = Manifest.once

    def once(self, part, settings, work):
        def counted():
            if when == "before" and part in wanted:
                wanted.remove(part)
                raise Broken(part)
            result = work()
            done.append(part)
            if when == "after" and part in wanted:
                wanted.remove(part)
                raise Broken(part)
            return result
        return plain(self, part, settings, counted)

    monkeypatch.setattr(Manifest, "once", once)
    for part in PARTS:
        with pytest.raises(Broken, match=f"^{part}$"):
            run(spark, schema, source)
    result = run(spark, schema, source)
    assert done == (PARTS if when == "before" else [part for part in PARTS for _ in range(2)])
    known = [(k,) for k in range(1, 10)]
    everything = [(None,), *known]
    dropped = sorted([(3, "model_short"), (8, "last"), (9, "last")])
    assert places(spark, rows, schema) == [everything, everything, everything, everything, 1, dropped]
    assert rows(result.outputs["last"].select("k")) == [(k,) for k in range(1, 8)]
    assert result.coverage["scored"].output_count == 9
    again = run(spark, schema, source)
    assert places(spark, rows, schema) == [everything, everything, everything, everything, 1, dropped]
    assert again.coverage == result.coverage and rows(again.dropped) == rows(result.dropped)


def test_changed_settings_are_refused(spark, schema, source):
    run(spark, schema, source)
    with pytest.raises(ChangedStepError, match="first"):
        run(spark, schema, source, least=2)


def test_tables_that_the_catalog_has_forgotten(spark, rows, schema, source, monkeypatch):
    result = run(spark, schema, source)
    location = Manifest(spark, result.schema, True).location
    expected = rows(result.outputs["last"])
    for name in ("first", "last"):
        # The entry goes and the files stay, as when a session's own catalog ends.
        spark.sql(f"ALTER TABLE {result.schema}.{name} SET LOCATION '{location}/nowhere_{name}'")
        spark.sql(f"DROP TABLE {result.schema}.{name}")
    monkeypatch.setattr(manifest_module, "stage", None)
    monkeypatch.setattr(steps_module, "require_coverage", None)
    assert rows(run(spark, schema, source).outputs["last"]) == expected
