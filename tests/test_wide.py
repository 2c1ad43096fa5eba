import datetime as dt
import os
import subprocess
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from threading import Barrier
from urllib.parse import urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidescore.operators import (
    ConcurrentMergeError,
    DuplicateKeyError,
    merge_into_wide,
    newest_per_key,
    read_wide,
    skew,
    upsert_newest,
    wide,
)
from tidescore.sources import commits, scratch_schema, set_properties, stage
from tidescore.sources.commits import table_folder
from tidescore.sources.files import Files
from tidescore.sources.tables import get_property

D1, D2, D3 = (dt.date(2024, 1, day) for day in (1, 2, 3))
FIELDS = "k int, v string, execution_date date"


@pytest.fixture(params=["small delta", "large delta"])
def delta_size(request, monkeypatch):
    if request.param == "large delta":
        monkeypatch.setattr(skew, "MAX_BROADCAST_BYTES", 0)
    return request.param


def test_newest_wins(spark, rows, delta_size):
    target = spark.createDataFrame(
        [(1, "old", D2), (2, "old", D2), (3, "old", D2), (4, "old", None), (5, "old", D2), (6, "old", D1),
         (None, "old", D1)], FIELDS)
    delta = spark.createDataFrame(
        [(1, "new", D3), (2, "new", D2), (3, "new", D1), (4, "new", D3), (5, "new", None), (7, "new", None),
         (None, "new", D3)], FIELDS)
    assert rows(upsert_newest(target, delta, "k")) == rows(spark.createDataFrame(
        [(1, "new", D3), (2, "old", D2), (3, "old", D2), (4, "old", None), (5, "old", D2), (6, "old", D1),
         (7, "new", None), (None, "old", D1), (None, "new", D3)], FIELDS))


def test_first_non_null_date_decides(spark, rows, delta_size):
    fields = "k int, v string, first date, second date"
    target = spark.createDataFrame([(1, "old", None, D2), (2, "old", D2, D1), (3, "old", None, None)], fields)
    delta = spark.createDataFrame([(1, "new", D3, D1), (2, "new", D1, D3), (3, "new", D3, D3)], fields)
    found = upsert_newest(target, delta, "k", "first,second")
    assert [row[:2] for row in rows(found)] == [(1, "new"), (2, "old"), (3, "old")]


def test_updates_write_nulls_and_go_by_name(spark, rows, delta_size):
    target = spark.createDataFrame([(1, "old", D1)], FIELDS)
    delta = spark.createDataFrame([(D2, None, 1, 9)], "execution_date date, v string, k int, extra int")
    assert rows(upsert_newest(target, delta, "k")) == [(1, None, D2)]
    with pytest.raises(ValueError, match="lacks"):
        upsert_newest(target, delta.drop("v"), "k")


def test_repeated_keys(spark, rows, delta_size):
    target = spark.createDataFrame([(1, "old", D1), (1, "older", D1), (2, "old", D3)], FIELDS)
    repeated = spark.createDataFrame([(1, "a", D2), (1, "b", D3), (1, "c", D3)], FIELDS)
    with pytest.raises(DuplicateKeyError):
        upsert_newest(target, repeated, "k")
    assert rows(upsert_newest(target, repeated, "k", on_duplicate="newest")) == [
        (1, "c", D3), (1, "c", D3), (2, "old", D3)]
    new = spark.createDataFrame([(9, "a", D2), (9, "b", D3)], FIELDS)
    assert rows(upsert_newest(target, new, "k"))[-2:] == [(9, "a", D2), (9, "b", D3)]
    with pytest.raises(ValueError):
        upsert_newest(target, new, "k", on_duplicate="other")


def test_newest_per_key_keeps_null_keys(spark, rows):
    delta = spark.createDataFrame([(None, "a", D1), (None, "b", D1), (1, "a", None), (1, "b", D1)], FIELDS)
    assert rows(newest_per_key(delta, "k", "execution_date")) == [(None, "a", D1), (None, "b", D1), (1, "b", D1)]


dates = st.one_of(st.none(), st.sampled_from([D1, D2, D3]))
sides = st.dictionaries(st.integers(0, 6), st.tuples(st.sampled_from("ab"), dates), max_size=6)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(old=sides, new=sides)
def test_against_plain_python(spark, rows, delta_size, old, new):
    def frame(side):
        return spark.createDataFrame([(k, *row) for k, row in side.items()], FIELDS)
    expected = dict(old)
    for k, row in new.items():
        if k not in old or (row[1] and old[k][1] and row[1] > old[k][1]):
            expected[k] = row
    once = upsert_newest(frame(old), frame(new), "k")
    assert rows(once) == rows(frame(expected))
    assert rows(upsert_newest(once, frame(new), "k")) == rows(once)


def test_merge_creates_then_merges(spark, rows, schema):
    name = f"{schema}.wide"
    first = spark.createDataFrame([(1, "old", "2024-01-02", 0), (2, "old", "2024-01-02", 0), (2, "two", "2024-01-02", 0),
                                   (None, "null", "2024-01-01", 0)], "k int, v string, execution_date string, x int")
    fields = "k,v,execution_date"
    now = "2024-05-01 00:00:00"
    merge_into_wide(spark, name, first, "k", select_fields=fields, date_updated=True, now=now, buckets=4)
    assert dict(read_wide(spark, name).dtypes) == {
        "k": "int", "v": "string", "execution_date": "date", "date_updated": "timestamp"}
    assert get_property(spark, name, "wide.buckets") == "4"
    delta = spark.createDataFrame([(1, "new", "2024-01-03"), (3, "new", "2024-01-01"), (None, "new", "2024-01-01")],
                                  "k int, v string, execution_date string")
    for _ in range(2):
        merge_into_wide(spark, name, delta, "k", date_updated=True, now=now, buckets=99)
    assert rows(read_wide(spark, name).drop("date_updated")) == [
        (None, "new", D1), (None, "new", D1), (None, "null", D1), (1, "new", D3),
        (2, "old", D2), (2, "two", D2), (3, "new", D1)]
    assert [row.name for row in spark.catalog.listTables(schema)] == ["wide"]


@pytest.mark.parametrize("staged", [True, False])
def test_merge_leaves_other_buckets_alone(spark, rows, schema, staged):
    name = f"{schema}.wide"
    first = spark.range(200).selectExpr("cast(id as int) k", "'old' v", "DATE'2024-01-01' execution_date")
    merge_into_wide(spark, name, first, "k", buckets=16, properties={"write.delete.mode": "merge-on-read"})
    assert get_property(spark, name, "write.delete.mode") == "merge-on-read"

    def files():
        parts = read_wide(spark, name).select(F.input_file_name().alias("f")).distinct().collect()
        return {row.f for row in parts}
    before = files()
    merge_into_wide(spark, name, spark.createDataFrame([(5, "new", D2)], FIELDS), "k", staged=staged)
    assert len(before - files()) == 1
    assert read_wide(spark, name).count() == 200
    assert read_wide(spark, name).filter("v = 'new'").count() == 1
    merge_into_wide(spark, name, spark.createDataFrame([], FIELDS), "k")
    assert read_wide(spark, name).count() == 200


def test_broken_off_replacement_is_finished(spark, rows, schema):
    """A complete staged table left behind by a broken-off merge is put in place by the next one."""
    name = f"{schema}.wide"
    merge_into_wide(spark, name, spark.createDataFrame([(1, "old", D1), (2, "old", D1)], FIELDS), "k", buckets=1)
    spark.createDataFrame([(1, "staged", D3, 0), (2, "old", D1, 0)], f"{FIELDS}, wt_bucket int").write.partitionBy(
        "wt_bucket").saveAsTable(f"{name}__merged_1")
    set_properties(spark, name, {"wide.pending": f"{name}__merged_1"})
    merge_into_wide(spark, name, spark.createDataFrame([(2, "new", D2)], FIELDS), "k")
    assert rows(read_wide(spark, name)) == [(1, "staged", D3), (2, "new", D2)]


def test_what_broken_runs_leave_does_no_harm(spark, rows, schema):
    """A half-written folder, a staged table that was never named, and one that is named and gone."""
    name = f"{schema}.wide"
    merge_into_wide(spark, name, spark.createDataFrame([(1, "old", D1)], FIELDS), "k", buckets=1)
    folder = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").first()[1]
    spark.range(3).write.parquet(f"{folder}__merged")
    spark.createDataFrame([(1, "never", D3, 0)], f"{FIELDS}, wt_bucket int").write.saveAsTable(f"{name}__merged_2")
    set_properties(spark, name, {"wide.pending": f"{name}__merged_gone"})
    merge_into_wide(spark, name, spark.createDataFrame([(1, "new", D2), (2, "new", D2)], FIELDS), "k")
    assert rows(read_wide(spark, name)) == [(1, "new", D2), (2, "new", D2)]


@pytest.mark.parametrize("staged", [True, False])
def test_two_merges_at_once(spark, schema, staged):
    """One of them raises, and every key keeps one row."""
    name = f"{schema}.wide"
    rows = spark.range(50).selectExpr("cast(id as int) k", "'old' v", "DATE'2024-01-01' execution_date")
    merge_into_wide(spark, name, rows, "k", buckets=2)
    gate, raised = Barrier(2), []

    def merge(value):
        delta = rows.withColumns({"v": F.lit(value), "execution_date": F.lit(D2)})
        try:
            merge_into_wide(spark, name, delta, "k", staged=staged)
        except ConcurrentMergeError:
            raised.append(value)

    def together(*arguments, stats=wide._delta_stats):
        found = stats(*arguments)
        gate.wait(60)
        return found

    with pytest.MonkeyPatch.context() as patch, ThreadPoolExecutor(2) as pool:
        patch.setattr(wide, "_delta_stats", together)
        list(pool.map(merge, ["a", "b"]))
    assert len(raised) == 1
    found = read_wide(spark, name).collect()
    assert len(found) == 50 and {row.v for row in found} == {"a", "b"} - set(raised)
    merge_into_wide(spark, name, rows.limit(1).withColumn("execution_date", F.lit(D3)), "k")
    assert read_wide(spark, name).filter("v = 'old'").count() == 1


def test_values_that_do_not_fit_are_refused(spark, rows, schema):
    name = f"{schema}.wide"
    merge_into_wide(spark, name, spark.createDataFrame([(1, 7, D1)], "k int, n bigint, execution_date date"), "k", buckets=2)
    for fields, row in (("k int, n double, execution_date date", (1, 7.9, D2)),
                        ("k double, n bigint, execution_date date", (1.9, 7, D2)),
                        ("k int, n string, execution_date date", (1, "7", D2)),
                        ("k bigint, n bigint, execution_date date", (1, 7, D2))):
        with pytest.raises(ValueError, match="does not fit"):
            merge_into_wide(spark, name, spark.createDataFrame([row], fields), "k")
    merge_into_wide(spark, name, spark.createDataFrame([(1, 8, D2)], "k smallint, n int, execution_date date"), "k")
    assert rows(read_wide(spark, name)) == [(1, 8, D2)]
    collated = spark.createDataFrame([("A", D1)], "k string, execution_date date")
    with pytest.raises(ValueError, match="collation"):
        merge_into_wide(spark, f"{schema}.other", collated.withColumn("k", F.collate("k", "UTF8_LCASE")), "k")


def test_maps_do_not_decide(spark, rows):
    fields = "k int, m map<string,int>, v int, execution_date date"
    delta = spark.createDataFrame([(1, {"a": 1}, 1, D1), (1, {"a": 2}, 2, D1), (None, {"b": 1}, 1, D1)], fields)
    assert rows(newest_per_key(delta, "k", "execution_date").filter("k = 1")) == [(1, {"a": 2}, 2, D1)]
    found = upsert_newest(delta.filter("v = 1 AND k = 1"), delta.filter("k = 1").withColumn("execution_date", F.lit(D2)),
                          "k", on_duplicate="newest")
    assert rows(found) == [(1, {"a": 2}, 2, D2)]


def test_delta_that_reads_the_wide_table(spark, rows, schema):
    name = f"{schema}.wide"
    merge_into_wide(spark, name, spark.createDataFrame([(1, "old", D1), (2, "old", D1)], FIELDS), "k", buckets=2)
    delta = read_wide(spark, name).filter("k = 1").withColumns({"v": F.lit("new"), "execution_date": F.lit(D2)})
    merge_into_wide(spark, name, delta, "k")
    assert rows(read_wide(spark, name)) == [(1, "new", D2), (2, "old", D1)]


def test_stored_delta_is_not_copied(spark, rows, schema):
    name = f"{schema}.wide"
    delta = stage(spark.createDataFrame([(1, "new", D2), (None, "null", D2), (3, "new", D2)], FIELDS), schema, "delta")
    merge_into_wide(spark, name, spark.createDataFrame([(1, "old", D1), (2, "old", D1)], FIELDS), "k", buckets=64,
                    date_updated=True)
    merge_into_wide(spark, name, delta, "k", date_updated=True, stored=True)
    assert rows(read_wide(spark, name).drop("date_updated")) == [
        (None, "null", D2), (1, "new", D2), (2, "old", D1), (3, "new", D2)]


def test_other_tables_are_refused(spark, schema):
    spark.createDataFrame([(1, "x", D1)], FIELDS).write.saveAsTable(f"{schema}.plain")
    with pytest.raises(ValueError, match="not created as a wide table"):
        merge_into_wide(spark, f"{schema}.plain", spark.createDataFrame([(1, "y", D2)], FIELDS), "k")


def test_null_keys_are_spread(spark, schema):
    name = f"{schema}.wide"
    merge_into_wide(spark, name, spark.range(500).selectExpr("cast(null as int) k", "cast(id as string) v",
                                                             "DATE'2024-01-01' execution_date"), "k", buckets=8)
    assert spark.table(name).select("wt_bucket").distinct().count() == 8
    set_properties(spark, name, {"write.delete.mode": "merge-on-read"})
    assert scratch_schema(spark) and skew.is_small(read_wide(spark, name))


def test_two_processes_merge_at_once(spark, schema, tmp_path):
    """Each with its own session and catalog: one is refused, no row is lost, and the next merge sees the winner's rows."""
    name = f"{schema}.wide"
    merge_into_wide(spark, name, spark.range(50).selectExpr("cast(id as int) k", "'old' v", "DATE'2024-01-01' execution_date"),
                    "k", buckets=2)
    folder, go = table_folder(spark, name), tmp_path / "go"
    script = Path(__file__).with_name("merge_process.py")
    workers = [subprocess.Popen([sys.executable, str(script), folder, str(tmp_path), value, str(tmp_path / f"ready_{value}"), str(go)],
                                stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True,
                                env={**os.environ, "PYTHONPATH": str(script.parent.parent)}) for value in "ab"]
    for _ in range(1200):
        if all((tmp_path / f"ready_{value}").exists() for value in "ab"):
            break
        assert all(worker.poll() is None for worker in workers)
        time.sleep(0.1)
    go.touch()
    said = [worker.communicate(timeout=120)[0].split()[-1] for worker in workers]
    assert sorted(said) == ["merged", "refused"]
    winner = "ab"[said.index("merged")]
    spark.catalog.refreshTable(name)
    found = read_wide(spark, name).collect()
    assert len(found) == 50 and {row.v for row in found} == {winner}
    merge_into_wide(spark, name, spark.createDataFrame([(7, "next", D3)], FIELDS), "k")
    assert sorted(row.v for row in read_wide(spark, name).collect()) == [winner] * 49 + ["next"]
    assert sorted(name for name in os.listdir(urlparse(folder).path) if name.startswith("_staged")) == []


class Broken(Exception):
    pass


@pytest.mark.parametrize("point", ["before the record", "after the record", "in the middle", "before it is marked as done"])
def test_a_merge_that_breaks_off(spark, rows, schema, monkeypatch, point):
    """Before its record it has not taken place; after it, it is finished by the next reader, and only once."""
    name = f"{schema}.wide"
    old = spark.createDataFrame([(1, "old", D1), (2, "old", D1), (None, "null", D1)], FIELDS)
    merge_into_wide(spark, name, old, "k", buckets=64)
    delta = spark.createDataFrame([(1, "new", D2), (3, "new", D2), (None, "more", D1)], FIELDS)
    left = [2]

    def breaks(plain):
        def function(*arguments):
            left[0] -= 1
            if point != "in the middle" or not left[0]:
                raise Broken
            return plain(*arguments)
        return function

    what = {"before the record": (commits.Log, "commit"), "after the record": (commits.Log, "finish"),
            "in the middle": (Files, "move"), "before it is marked as done": (commits.Log, "register")}[point]
    finish = commits.Log.finish
    with monkeypatch.context() as patch:
        if point == "after the record":
            # The merge first finishes the one before it.
            patch.setattr(*what, lambda log, record: finish(log, record) if int(record) < 2 else breaks(finish)(log, record))
        else:
            patch.setattr(*what, breaks(getattr(*what)))
        with pytest.raises(Broken):
            merge_into_wide(spark, name, delta, "k", run="r1")
    expected = [(None, "null", D1), (1, "old", D1), (2, "old", D1)]
    merged = [(None, "more", D1), (None, "null", D1), (1, "new", D2), (2, "old", D1), (3, "new", D2)]
    assert rows(read_wide(spark, name)) == (expected if point == "before the record" else merged)
    for _ in range(2):
        merge_into_wide(spark, name, delta, "k", run="r1")
        assert rows(read_wide(spark, name)) == merged


def test_who_is_late_harms_nothing(spark, rows, schema):
    """A process that finishes an older merge again after later ones changes nothing."""
    name = f"{schema}.wide"
    for value, day in (("a", D1), ("b", D2), ("c", D3)):
        merge_into_wide(spark, name, spark.createDataFrame([(1, value, day)], FIELDS), "k", buckets=1)
    log = commits.Log(spark, name, "merges")
    log.files.delete(f"{log.records}/{1:012d}.done")
    with pytest.raises(commits.LostChangeError):
        log.finish(f"{1:012d}")  # without its mark its files count as lost
    for number in (2, 3):
        log.finish(f"{number:012d}")
    assert rows(read_wide(spark, name)) == [(1, "c", D3)]
