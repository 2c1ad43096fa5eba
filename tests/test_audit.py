import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidescore.operators import (
    CoverageError,
    EmptyKernelError,
    coverage,
    dropped_rows,
    exclude_seen,
    funnel_audit,
    require_coverage,
    seen_since,
    skew,
    validate_results,
)

LEFT = [(1,), (2,), (2,), (None,)]
RULES = {
    "except": {"one_and_null": [(2,)], "one": [(None,), (2,)], "empty": [(None,), (1,), (2,)]},
    "sql": {"one_and_null": [], "one": [(2,), (2,)], "empty": [(None,), (1,), (2,), (2,)]},
    "keep": {"one_and_null": [(None,), (2,), (2,)], "one": [(None,), (2,), (2,)],
             "empty": [(None,), (1,), (2,), (2,)]},
}
RIGHT = {"one_and_null": [(1,), (None,)], "one": [(1,), (1,)], "empty": []}


@pytest.mark.parametrize("right", RIGHT)
@pytest.mark.parametrize("nulls", RULES)
def test_three_null_rules(spark, rows, nulls, right):
    kernel = spark.createDataFrame(LEFT, "k int")
    output = spark.createDataFrame(RIGHT[right], "k int")
    dropped = dropped_rows(kernel, output, "k", "s", nulls=nulls)
    assert rows(dropped.select("k")) == RULES[nulls][right]
    assert dict(dropped.dtypes) == {"k": "int", "drop_step": "string", "priority": "double"}
    assert {row[1:] for row in rows(dropped)} <= {("s", 1.0)}


def test_empty_left(spark, rows):
    empty = spark.createDataFrame([], "k int")
    for nulls in RULES:
        assert rows(dropped_rows(empty, spark.createDataFrame([(1,)], "k int"), "k", "s", nulls=nulls)) == []


def test_two_key_columns(spark, rows):
    kernel = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (2, "a")], "k int, l string")
    output = spark.createDataFrame([(1, "a"), (1, None)], "k int, l string")
    assert rows(dropped_rows(kernel, output, "k,l", "s").select("k", "l")) == [(2, "a")]
    assert rows(dropped_rows(kernel, output, "k,l", "s", nulls="keep").select("k", "l")) == [
        (1, None), (2, "a"), (2, "a")]
    with pytest.raises(ValueError):
        dropped_rows(kernel, output, "k,l", "s", nulls="sql")
    with pytest.raises(ValueError):
        dropped_rows(kernel, output, "k", "s", nulls="other")


keys = st.lists(st.one_of(st.none(), st.integers(0, 4)), max_size=8)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=keys, right=keys)
@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_same_as_spark_not_in_and_except(spark, rows, monkeypatch, broadcast_bytes, left, right):
    monkeypatch.setattr(skew, "MAX_BROADCAST_BYTES", broadcast_bytes)
    kernel = spark.createDataFrame([(k,) for k in left], "k int")
    output = spark.createDataFrame([(k,) for k in right], "k int")
    not_in = spark.sql("SELECT k FROM {l} WHERE k NOT IN (SELECT k FROM {r})", l=kernel, r=output)
    assert rows(dropped_rows(kernel, output, "k", "s", nulls="sql").select("k")) == rows(not_in)
    missing = dropped_rows(kernel, output, "k", "s", nulls="except").select("k")
    assert rows(missing) == rows(kernel.subtract(output))
    kept = dropped_rows(kernel, output, "k", "s", nulls="keep").select("k")
    assert rows(kept) == rows(kernel.join(output, "k", "left_anti"))


def test_funnel_pairs(spark, rows):
    steps = [("a", [1, 2, 3, 4, 4]), ("b", [2, 3, 4, 4]), ("c", [2, 3, 4, 4]), ("d", [])]
    outputs = [(name, spark.createDataFrame([(k,) for k in ks], "k int")) for name, ks in steps]
    assert rows(funnel_audit(outputs, "k")) == [
        (1, "b", 2.0), (2, "d", 2.0), (3, "d", 2.0), (4, "d", 2.0), (4, "d", 2.0)]
    with pytest.raises(ValueError):
        funnel_audit(outputs[:1], "k")


def test_coverage_at_the_threshold(spark):
    kernel, output = spark.range(100), spark.range(99)
    assert coverage(kernel, output).collect() == [(100, 99, 99.0, True)]
    assert coverage(kernel, spark.range(98)).first().passed is False
    assert require_coverage(kernel, output).output_count == 99
    with pytest.raises(CoverageError, match="98 of 100"):
        require_coverage(kernel, spark.range(98), step="m")
    assert all(coverage(kernel, spark.range(n), threshold=n).first().passed for n in (7, 14, 28, 29, 55, 57, 58))
    assert coverage(spark.range(1000), spark.range(999), threshold=99.9).first().passed
    assert not coverage(spark.range(1000), spark.range(998), threshold=99.9).first().passed


def test_coverage_over_100_and_matched(spark):
    kernel = spark.range(2)
    output = spark.createDataFrame([(0,), (0,), (0,), (7,)], "id bigint")
    assert coverage(kernel, output).collect() == [(2, 4, 200.0, True)]
    assert coverage(kernel, output, key="id").collect() == [(2, 4, 1, 200.0, True)]


def test_empty_kernel(spark):
    empty = spark.range(0)
    assert coverage(empty, spark.range(3)).collect() == [(0, 3, None, False)]
    assert coverage(empty, empty, key="id").collect() == [(0, 0, 0, None, False)]
    with pytest.raises(EmptyKernelError):
        require_coverage(empty, spark.range(3))


def test_validate(spark, rows):
    row, dropped = validate_results(spark.range(4), spark.range(3), "id", "short", threshold=75)
    assert (row.pct, rows(dropped)) == (75.0, [(3, "model_short", 1.0)])
    with pytest.raises(CoverageError):
        validate_results(spark.range(4), spark.range(2), "id", "short", threshold=75)


def test_exclude_seen_window(spark, rows):
    seen = spark.createDataFrame(
        [(1, 5, "2024-01-20 00:00:00"), (2, 5, "2024-02-01 00:00:00"), (3, 5, "2024-02-01 00:00:01"),
         (4, 5, "2024-01-19 23:59:59"), (5, 6, "2024-01-25 00:00:00"), (None, 5, "2024-01-25 00:00:00")],
        "k int, evid int, d string").select("k", "evid", F.col("d").cast("timestamp_ntz").alias("date_created"))
    source = spark.createDataFrame([(1,), (2,), (3,), (3,), (4,), (5,), (None,)], "k int")
    left = exclude_seen(source, seen, "k", seen_since(5, "2024-01-20", "2024-02-01"))
    assert rows(left) == [(None,), (3,), (3,), (4,), (5,)]
    assert rows(exclude_seen(source, seen, "k", seen_since(5, "2024-01-20"))) == rows(
        exclude_seen(source, seen, "k", seen_since(5, "2024-01-20", "2100-01-01")))
