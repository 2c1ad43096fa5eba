import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidescore.functions import (
    add_date_updated,
    cap_rows,
    cast_date_if_present,
    nullify,
    project_features,
    stamp_run,
)
from tidescore.operators import (
    append_to_history,
    exclude_seen,
    outbox_row,
    snapshot_max_ts,
    snapshot_ready,
    write_events,
)
from tidescore.sources import (
    create_table,
    drop_listed_tables,
    drop_tables,
    ensure_table,
    insert_rows,
    load,
    move_with_view,
    replace_rows,
    restore_table,
    store,
    table_exists,
)


def test_create_and_swap(spark, rows, schema):
    name = f"{schema}.t"
    create_table(spark, "SELECT id FROM range(:n)", name, args={"n": 4})
    create_table(spark, f"SELECT id + 10 AS id FROM {name} WHERE id > 1", name, swap=True)
    assert rows(load(spark, name)) == [(12,), (13,)]
    with pytest.raises(Exception):
        create_table(spark, spark.range(2).select(F.raise_error(F.lit("broken"))), name, swap=True)
    assert rows(load(spark, name)) == [(12,), (13,)]
    assert create_table(spark, spark.range(9), name, limit=0).count() == 0
    assert create_table(spark, spark.range(9), name, limit=-1).count() == 9


def test_store_by_path(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    store(spark.range(2), path)
    store(spark.range(2, 3), path, "append")
    assert rows(load(spark, path)) == [(0,), (1,), (2,)]


def test_ensure_insert_drop(spark, rows, schema):
    name = f"{schema}.dropped"
    ensure_table(spark, name, "k string, drop_step string, priority double")
    insert_rows(spark.createDataFrame([(1, "s", "a")], "priority int, drop_step string, k string"), name)
    ensure_table(spark, name, spark.table(name).schema)
    assert rows(load(spark, name)) == [("a", "s", 1.0)]
    drop_tables(spark, [name, name, None, ""])
    assert not table_exists(spark, name)


def test_drop_listed(spark, schema):
    for table in "abc":
        create_table(spark, spark.range(1), f"{schema}.{table}")
    first = replace_rows(spark, f"{schema}.first", [(f"{schema}.a", f"{schema}.b"), (f"{schema}.gone", None)],
                         "table_name string, enriched_table_name string")
    drop_listed_tables(spark, [first, first])
    assert [table_exists(spark, f"{schema}.{table}") for table in "abc"] == [False, False, True]


def test_move_with_view(spark, rows, schema):
    create_table(spark, spark.range(2), f"{schema}.old")
    move_with_view(spark, f"{schema}.old", f"{schema}.new")
    assert rows(load(spark, f"{schema}.old")) == rows(load(spark, f"{schema}.new")) == [(0,), (1,)]


def test_columns(spark, rows):
    df = spark.createDataFrame([(1, "2024-01-02", " ", "a")], "k int, execution_date string, b string, c string")
    assert project_features(df, "k", "c,k,b").columns == ["k", "c", "b"]
    assert rows(nullify(df)) == [(1, "2024-01-02", None, "a")]
    day = dt.date(2024, 1, 2)
    assert rows(stamp_run(df, "daily").select("run_type", "execution_date")) == [("daily", day)]
    assert rows(stamp_run(df, "", "2024-05-06").select("execution_date")) == [(dt.date(2024, 5, 6),)]
    with pytest.raises(ValueError):
        stamp_run(df.drop("execution_date"), "daily")
    assert cast_date_if_present(df).schema["execution_date"].dataType.simpleString() == "date"
    assert cast_date_if_present(df.drop("execution_date")).columns == ["k", "b", "c"]
    assert add_date_updated(df).columns[-1] == "date_updated"
    assert rows(add_date_updated(df.select(F.lit(1).alias("date_updated")))) == [(1,)]
    assert [cap_rows(spark.range(5), n).count() for n in (None, -1, 0, 3, 9)] == [5, 5, 0, 3, 5]


def test_bad_date_raises(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        stamp_run(spark.range(1), None, "not a date").collect()


def test_history(spark, rows, schema):
    name = f"{schema}.history"
    df = spark.createDataFrame([(1, "", "2024-01-02"), (2, "x", "2024-01-03")], "k int, v string, execution_date string")
    append_to_history(df, name, "daily", sort_by="k")
    append_to_history(df, name, "monthly", "2024-02-01", columns="k,v")
    append_to_history(df, name, "monthly", "2024-02-01", columns="v,k")
    found = load(spark, name).select("k", "v", "run_type", F.col("execution_date").cast("string"))
    late = [(1, None, "monthly", "2024-02-01"), (2, "x", "monthly", "2024-02-01")]
    assert rows(found) == sorted([(1, None, "daily", "2024-01-02"), (2, "x", "daily", "2024-01-03"), *late, *late],
                                 key=lambda row: (row[0], row[1] or "", row[2], row[3]))
    with pytest.raises(ValueError):
        append_to_history(df, name, "daily", columns="k,v")
    with pytest.raises(ValueError, match="partitioned by"):
        append_to_history(df, name, "daily", "2024-02-01", replace_run=True)


def test_history_replace_run(spark, rows, schema):
    name = f"{schema}.history"
    df = spark.range(3).withColumn("v", F.lit("x"))
    with pytest.raises(ValueError, match="needs"):
        append_to_history(df, name, "daily", replace_run=True)
    for run_type, date, frame in (("it's", "2024-01-01", df), ("b", "2024-01-01", df), ("it's", "2024-01-02", df),
                                  ("it's", "2024-01-01", df.filter("id = 1")), ("b", dt.date(2024, 1, 1), df.limit(0))):
        append_to_history(frame, name, run_type, date, replace_run=True)
    found = load(spark, name).select(F.col("execution_date").cast("string"), "run_type", "id", "v")
    assert rows(found) == [("2024-01-01", "it's", 1, "x"), ("2024-01-02", "it's", 0, "x"),
                           ("2024-01-02", "it's", 1, "x"), ("2024-01-02", "it's", 2, "x")]


REGISTRY = {"source_number": 7, "endpoint": "things", "priority": 2}


def test_few_rows_in_many_tasks_make_one_file(spark, schema):
    name = f"{schema}.history"
    rows = spark.range(0, 4000, numPartitions=400).filter("id % 400 = 0")
    append_to_history(rows, name, "daily", "2024-01-01")
    assert load(spark, name).select(F.input_file_name()).distinct().count() == 1


def test_replace_run_with_odd_column_names(spark, rows, schema):
    name = f"{schema}.history"
    df = spark.range(2).select("id", F.lit(1).alias("a b"), F.lit(2).alias("select"))
    for _ in range(2):
        append_to_history(df, name, "daily", "2024-01-01", replace_run=True)
    assert rows(load(spark, name).select("id", "a b", "select")) == [(0, 1, 2), (1, 1, 2)]


def test_broken_swaps(spark, rows, schema):
    """Folders left by a write, and a break before and after the new table is there, do no harm."""
    name = f"{schema}.t"
    create_table(spark, spark.range(1), name)
    folder = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").first()[1]
    spark.range(5).write.parquet(f"{folder}__new_half")
    create_table(spark, spark.range(2), name, swap=True)
    assert load(spark, name).count() == 2
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__replaced_1")
    restore_table(spark, name)
    assert load(spark, name).count() == 2
    create_table(spark, spark.range(9), f"{name}__replaced_2")
    create_table(spark, f"SELECT id + 1 AS id FROM {name}", name, swap=True)
    assert rows(load(spark, name)) == [(1,), (2,)]
    assert [row.name for row in spark.catalog.listTables(schema)] == ["t"]


def test_outbox(spark, rows, schema):
    registry = f"{schema}.registry"
    now = "2024-01-01 12:00:00"
    for count in (3, 2):
        write_events(spark.range(count), f"{schema}.events", registry, 1511, now=now, **REGISTRY)
    assert load(spark, f"{schema}.events").count() == 2
    row = (dt.datetime(2024, 1, 1, 12), f"{schema}.events", "things", 7, 1511, True, 2)
    assert rows(load(spark, registry)) == [row, row]
    known = load(spark, f"{schema}.events").filter("id = 1")
    write_events(exclude_seen(spark.range(4), known, "id"), f"{schema}.events", registry, 1511, **REGISTRY)
    assert rows(load(spark, f"{schema}.events")) == [(0,), (2,), (3,)]
    assert dict(outbox_row(spark, "t", 1, **REGISTRY).dtypes) == {
        "date_created": "timestamp_ntz", "table_name": "string", "endpoint": "string", "source_number": "int",
        "evid": "int", "drop_table": "boolean", "priority": "int"}


def test_snapshot(spark, rows):
    day = 1_705_276_800_000  # 2024-01-15
    df = spark.createDataFrame(
        [(day + 1500, "2024-01-15"), (day + 86_399_999, "2024-01-15"), (day + 86_400_000, "2024-01-15"),
         (day - 1, "2024-01-15"), (day + 86_399_999, "2024-01-16"), (None, "2024-01-15")],
        "ms bigint, d string").select("ms", F.to_date("d").alias("partition_date"))
    assert rows(snapshot_max_ts(df, "2024-01-15", "ms")) == [(dt.datetime(2024, 1, 15, 23, 59, 59, 999000),)]
    assert snapshot_ready(df.filter(f"ms < {day + 2000}"), dt.date(2024, 1, 15), "ms") == dt.datetime(
        2024, 1, 15, 0, 0, 1, 500000)
    assert snapshot_ready(df, "2024-01-17", "ms") is None
    before_1970 = spark.createDataFrame([(-1,)], "ms bigint")
    assert snapshot_ready(before_1970, "1969-12-31", "ms", None) == dt.datetime(1969, 12, 31, 23, 59, 59, 999000)


def test_own_times(spark):
    """Without a given time, rows are stamped with the time of the run."""
    def clock(function):
        return spark.range(1).select(function()).first()[0]

    for made, function in ((lambda: add_date_updated(spark.range(1)).first().date_updated, F.current_timestamp),
                           (lambda: outbox_row(spark, "t", 1, **REGISTRY).first().date_created, F.localtimestamp)):
        begin, value, end = clock(function), made(), clock(function)
        assert begin <= value <= end and end - begin < dt.timedelta(minutes=5)
