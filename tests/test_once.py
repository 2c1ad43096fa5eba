"""Changes that take place once, and tables that are replaced without a gap."""

import datetime as dt
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidescore.operators import append_once, append_to_history, funnel_audit, write_events
from tidescore.operators import outbox as outbox_module
from tidescore.sources import commits, create_table, drop_tables, load, publish_table, restore_published, restore_table, versions
from tidescore.sources.files import Files

REGISTRY = {"source_number": 7, "endpoint": "things", "priority": 2}


class Broken(Exception):
    pass


def broken(*arguments, **more):
    raise Broken


def names(spark, schema):
    return sorted(row.name for row in spark.catalog.listTables(schema))


@pytest.mark.parametrize("local", [True, False])
def test_a_file_is_created_once(spark, tmp_path, local):
    """By a link, and by the refusing rename of other file systems."""
    files = Files(spark, f"file://{tmp_path}")
    assert files.is_local
    files.is_local = local
    path = f"file://{tmp_path}/a b/record"
    assert files.names(f"file://{tmp_path}/a b") == []
    assert files.create_if_absent(path, "één") and not files.create_if_absent(path, "two")
    assert files.read(path) == "één" and files.names(f"file://{tmp_path}/a b") == ["record"]
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: files.create_if_absent(f"{path}_{k // 8}", str(k)), range(32)))
    assert not local or sum(won) == 4  # local renames only look first


def test_append_once(spark, rows, schema):
    name = f"{schema}.t"
    df = spark.createDataFrame([(1, "a/b=c", "x"), (2, None, "it's %41"), (3, "", None)], "k int, v string, p string")
    assert append_once(df, name, "run 1", "p")
    assert not append_once(df, name, "run 1", "p")
    assert append_once(df.select("p", "v", F.col("k").cast("smallint").alias("k")), name, "run 2")
    once = [(1, "a/b=c", "x"), (2, None, "it's %41"), (3, "", None)]
    assert rows(load(spark, name)) == sorted(once * 2, key=lambda row: row[0])
    assert load(spark, name).filter("p = \"it's %41\"").count() == 2
    with pytest.raises(ValueError, match="no columns"):
        append_once(df.withColumn("more", F.lit(1)), name, "run 3")
    with pytest.raises(ValueError, match="does not fit"):
        append_once(df.withColumn("k", F.lit("1")), name, "run 3")
    assert append_once(df.limit(0), name, "run 4") and load(spark, name).count() == 6


@pytest.mark.parametrize("point", ["stage", "commit", "finish", "register"])
def test_a_history_run_that_breaks_off(spark, schema, monkeypatch, point):
    name = f"{schema}.history"
    df = spark.range(5).withColumn("execution_date", F.expr("date'2024-01-01' + cast(id % 2 as int)"))
    append_to_history(df, name, "daily", run="first")
    with monkeypatch.context() as patch:
        patch.setattr(commits.Log, point, broken)
        with pytest.raises(Broken):
            append_to_history(df, name, "daily", run="second")
    for _ in range(2):
        append_to_history(df, name, "daily", run="second")
        assert load(spark, name).count() == 10
        assert load(spark, name).filter("execution_date = '2024-01-02'").count() == 4


def test_events_are_announced_once(spark, rows, schema, monkeypatch):
    registry, events = f"{schema}.registry", f"{schema}.events"
    with monkeypatch.context() as patch:
        patch.setattr(outbox_module, "append_once", broken)
        with pytest.raises(Broken):
            write_events(spark.range(3), events, registry, 5, run="r1", **REGISTRY)
    for _ in range(2):
        write_events(spark.range(3), events, registry, 5, run="r1", **REGISTRY)
    assert load(spark, events).count() == 3 and load(spark, registry).count() == 1
    write_events(spark.range(4), events, registry, 5, run="r2", now="2024-01-01 12:00:00", **REGISTRY)
    assert load(spark, events).count() == 4 and load(spark, registry).count() == 2
    assert (dt.datetime(2024, 1, 1, 12), events, "things", 7, 5, True, 2) in rows(load(spark, registry))


def test_a_reader_never_misses_a_published_table(spark, rows, schema):
    name = f"{schema}.t"
    publish_table(spark, "SELECT id, :v AS v FROM range(10)", name, args={"v": 0})
    stop, seen, failed = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                seen.append(sorted({(row.v, row.n) for row in spark.table(name).groupBy("v").agg(F.count("*").alias("n")).collect()}))
            except Exception as error:
                failed.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    for _ in range(8):
        publish_table(spark, f"SELECT id, v + 1 AS v FROM {name}", name)
    stop.set()
    reader.join()
    assert not failed
    assert all(len(one) == 1 and one[0][1] == 10 for one in seen) and len({one[0][0] for one in seen}) > 2
    assert rows(spark.table(name).select("v").distinct()) == [(8,)]
    assert len(names(spark, schema)) == 3  # the view, its version and the one before
    drop_tables(spark, [name, name])
    assert names(spark, schema) == []


@pytest.mark.parametrize("point", ["store", "set_properties", "restore_published"])
def test_a_publication_that_breaks_off(spark, rows, schema, monkeypatch, point):
    name = f"{schema}.t"
    create_table(spark, spark.range(2), name)
    publish_table(spark, spark.range(3), name)  # a plain table becomes the first version
    with monkeypatch.context() as patch:
        patch.setattr(versions, point, broken)
        with pytest.raises(Broken):
            publish_table(spark, spark.range(4), name)
    assert rows(load(spark, name)) == [(0,), (1,), (2,)]
    publish_table(spark, f"SELECT id + 1 AS id FROM {name}", name, limit=2)
    assert load(spark, name).count() == 2


def test_a_plain_table_left_between_its_renames(spark, rows, schema):
    name = f"{schema}.t"
    create_table(spark, spark.range(2), f"{name}{versions.VERSION}{versions.PLAIN}")
    restore_published(spark, name)
    assert rows(load(spark, name)) == [(0,), (1,)]


def test_the_newest_old_table_comes_back(spark, rows, schema):
    name = f"{schema}.t"
    for number in (2, 3, 1):
        create_table(spark, spark.range(number), f"{name}__replaced_{number:020d}_x")
    restore_table(spark, name)
    assert load(spark, name).count() == 3 and len(names(spark, schema)) == 3
    restore_table(spark, name)
    assert names(spark, schema) == ["t"]


def test_funnel_shuffles_keys_once(spark, rows):
    steps = [("a", spark.createDataFrame([(1,), (1,), (2,), (None,), (3,)], "k int")),
             ("b", spark.createDataFrame([(2,), (3,)], "k int")), ("c", spark.createDataFrame([(3,), (None,)], "k int")),
             ("d", spark.createDataFrame([(9,)], "k int")), ("e", spark.createDataFrame([], "k int")),
             ("f", spark.createDataFrame([(5,)], "k int"))]
    found = funnel_audit(steps, "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == [(1, "b", 2.0), (1, "b", 2.0), (3, "d", 2.0), (9, "e", 2.0)]
    assert plan.count("Exchange hashpartitioning") == 1
    null_rows = [("a", steps[0][1]), ("b", steps[4][1])]
    assert rows(funnel_audit(null_rows, "k")) == [(None, "b", 2.0), (1, "b", 2.0), (1, "b", 2.0), (2, "b", 2.0), (3, "b", 2.0)]
    many = [("a", spark.range(25_000).select(F.lit(1).alias("k"))), ("b", steps[4][1])]
    assert funnel_audit(many, "k").count() == 25_000
    assert funnel_audit([("a", steps[0][1]), ("b", steps[2][1])], "k").count() == 0
