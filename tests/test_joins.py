import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidescore.functions import inline_rows, pending, stack_distinct
from tidescore.operators import (
    asof,
    broadcast_if_small,
    enrich_features,
    fill_missing,
    hot_keys,
    is_small,
    join_result,
    left_join,
    score,
    score_with_columns,
    skew,
)


def test_join_result(spark, rows):
    kernel = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "k int, f string")
    predictions = spark.createDataFrame([(1, "?", 0.5), (1, "?", 0.6), (9, "?", 0.9), (None, "?", 0.1)],
                                        "k int, f string, p double")
    expected = [(None, "n", None), (1, "x", 0.5), (1, "x", 0.6), (2, "y", None), (3, "z", None)]
    for options in ({}, {"broadcast": False}, {"broadcast": False, "max_key_rows": 1},
                    {"broadcast": False, "max_key_rows": None}):
        assert rows(join_result(kernel, predictions, "k", "f,absent,k", **options)) == expected
    with pytest.raises(ValueError, match="both sides"):
        join_result(kernel, predictions, "k")


def test_left_join_with_hot_right_keys(spark, rows):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "n"), (4, "a")], "k int, l string")
    right = spark.range(30).select(F.when(F.col("id") < 20, 1).otherwise(F.col("id") % 3 + 2).cast("int").alias("k"), "id")
    plain = left.join(right, "k", "left")
    assert rows(left_join(left, right, "k", 5, broadcast=False)) == rows(plain)
    assert sorted(hot_keys(right, "k", 5).collect()) == [(1, 20)]
    assert hot_keys(right, "k", 20) is None
    assert hot_keys(right, "k", None) is None


def test_sizes(spark):
    text = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert is_small(text, 110_000) and not is_small(text, 90_000)
    assert not is_small(spark.range(1000), 8_000) and is_small(spark.range(1000), 16_000)
    nested = spark.range(100).select(F.array_repeat(F.lit("x" * 100), 10).alias("a"))
    assert is_small(nested, 150_000) and not is_small(nested, 90_000)
    assert is_small(text.limit(0), 1)
    assert broadcast_if_small(text, 90_000) is text
    variant = spark.range(1).select(F.parse_json(F.lit("1")).alias("v"))
    for odd in (variant, variant.select(F.array("v")), variant.select(F.struct("v"))):
        assert not is_small(odd, 1 << 40)


def test_fill_missing(spark, rows):
    base = spark.createDataFrame([(1, "a", None), (2, None, None), (3, None, 5), (None, None, 1)], "k int, v string, n int")
    updates = spark.createDataFrame([(1, "x", 7), (2, "y", None), (8, "z", 8), (None, "w", 3)], "k int, v string, n int")
    assert rows(fill_missing(base, updates, "k", "v,n")) == [
        (None, None, 1), (1, "a", 7), (2, "y", None), (3, None, 5)]
    assert rows(pending(base, "v").select("k")) == [(None,), (2,), (3,)]


def test_stack_distinct(spark, rows):
    one = spark.createDataFrame([("a", "b"), ("a", None)], "t string, e string")
    two = spark.createDataFrame([("b", "b"), ("c", "c")], "t string, e string")
    assert rows(stack_distinct([one, two], ["t", "e"])) == [(None,), ("a",), ("b",), ("c",)]
    assert inline_rows(spark, [(1,), (1,)], "a int").count() == 1


def at(hour):
    return dt.datetime(2024, 1, 1, hour)


@pytest.mark.parametrize("limit", [None, 1, 2, 3, 1000])
def test_enrich(spark, rows, limit):
    kernel = spark.createDataFrame(
        [(1, "a", at(5)), (2, "a", at(1)), (3, "a", at(9)), (4, "b", at(5)), (5, "c", at(5)), (6, None, at(5)),
         (7, "a", None), (8, "a", at(5))], "id int, k string, ts timestamp_ntz")
    features = spark.createDataFrame(
        [("a", at(2), "early", 1), ("a", at(5), "same", 2), ("a", at(5), "same", 3), ("a", at(8), None, 4),
         ("b", at(6), "late", 5), (None, at(1), "null", 6), ("c", None, "null", 7), ("d", at(1), "other", 8)],
        "k string, at timestamp_ntz, f string, n int")
    found = enrich_features(kernel, features, "k", "f,n", "ts", "at", max_key_rows=limit)
    assert rows(found.select("id", "f", "n")) == [
        (1, "same", 3), (2, None, None), (3, None, 4), (4, None, None), (5, None, None), (6, None, None),
        (7, None, None), (8, "same", 3)]
    assert found.columns == ["id", "k", "ts", "f", "n"]
    since = enrich_features(kernel, features, "k", "f,n", "ts", "at", at(6), max_key_rows=limit)
    assert rows(since.filter("f IS NOT NULL OR n IS NOT NULL").select("id", "n")) == [(3, 4)]
    with pytest.raises(ValueError, match="already"):
        enrich_features(kernel, features.withColumn("id", F.lit(1)), "k", "id", "ts", "at")


@pytest.mark.parametrize("limit", [None, 40, 500])
def test_enrich_against_pandas(spark, limit):
    """One user with a third of all rows, many of them at equal times."""
    ids = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(40))).cast("int").alias("k"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(700)).cast("int").alias("at"))
    kernel, features = ids.filter("id % 2 = 0"), ids.filter("id % 2 = 1").withColumnRenamed("id", "f")
    found = enrich_features(kernel, features, "k", "f", "at", max_key_rows=limit).toPandas().sort_values("id")
    left = kernel.toPandas().sort_values(["at", "id"])
    right = features.toPandas().sort_values(["at", "f"]).drop_duplicates(["k", "at"], keep="last")
    expected = pd.merge_asof(left, right, on="at", by="k").sort_values("id")
    assert found["f"].fillna(-1).tolist() == expected["f"].fillna(-1).tolist()


def test_enrich_with_a_map(spark, rows):
    kernel = spark.createDataFrame([(1, at(5))], "k int, ts timestamp_ntz")
    features = spark.createDataFrame([(1, at(2), {"a": 1}, 7), (1, at(4), {"a": 2}, 8), (1, at(4), {"a": 3}, 9)],
                                     "k int, ts timestamp_ntz, m map<string,int>, f int")
    assert rows(enrich_features(kernel, features, "k", "m,f", "ts")) == [(1, at(5), {"a": 3}, 9)]
    assert enrich_features(kernel, features, "k", "m", "ts").count() == 1


def test_score_passes_keys_and_features_through(spark):
    """Nulls next to large numbers, both instants of a repeated hour, and a year that nanoseconds do not reach."""
    def load_model():
        return lambda batch: pd.DataFrame({"p": batch["n"] + 1}, index=batch.index).iloc[::-1]

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame(
            [(2**53 + 1, 1_730_610_000, 2**53 + 1), (None, 1_730_613_600, None), (3, 253_402_300_799, 1)],
            "k bigint, s bigint, n bigint").select("k", F.timestamp_seconds("s").alias("ts"), "n")
        for key in ("k,ts", "ts,k"):
            found = score(df, key, "n,ts", load_model, "p bigint")
            assert found.columns == [*key.split(","), "n", "p"]
            expected = df.select(F.unix_micros("ts"), "k", "n", F.col("n") + 1)
            assert found.select(F.unix_micros("ts"), "k", "n", "p").exceptAll(expected).isEmpty() and found.count() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_score(spark, rows):
    def load_model():
        return lambda batch: pd.DataFrame({"p": batch["n"] * 0.5}, index=batch.index)[batch["n"] > 1]

    df = spark.createDataFrame([(1, 1, "x"), (2, 2, "x"), (3, 3, "x")], "k int, n int, other string")
    found = score(df, "k", "n,k", load_model, "p double")
    assert found.columns == ["k", "n", "p"] and rows(found) == [(2, 2, 1.0), (3, 3, 1.5)]
    assert rows(score_with_columns(df, "k", "n", {"p": F.col("n") * 2})) == [(1, 1, 2), (2, 2, 4), (3, 3, 6)]


def test_rows_of_other_keys_go_before_the_shuffle(spark, rows, monkeypatch):
    facts = spark.range(20_000).select((F.col("id") % 2000).cast("int").alias("k"), F.concat(F.lit("s"), F.col("id") % 2000).alias("s"),
                                       F.timestamp_seconds("id").alias("ts"), F.col("id").alias("f"))
    kernel = spark.range(40).select((F.col("id") * 31).cast("int").alias("k"), F.concat(F.lit("s"), F.col("id") * 31).alias("s"),
                                    F.timestamp_seconds(F.col("id") * 500).alias("ts"))
    keys = {row.k for row in kernel.collect()}
    for key in ("k", "s", ["k", "s"]):
        kept = skew.among_keys(facts, kernel, key)
        assert kept.columns == facts.columns
        assert kept.filter(F.col("k").isin(*keys)).count() == 10 * len(keys)
        assert kept.count() <= 10 * len(keys) + 20  # one key of another kind at most
    few = skew.among_keys(facts, kernel, "k", bits=4)
    assert few.filter(F.col("k").isin(*keys)).count() == 10 * len(keys)
    assert skew.among_keys(facts, kernel.withColumn("k", F.col("k").cast("bigint")), "k").count() == 20_000
    assert skew.among_keys(facts, kernel.limit(0), "k").count() == 0

    seen = []
    plain = asof._by_key
    monkeypatch.setattr(asof, "_by_key", lambda rows, facts, keys: seen.append(facts.count()) or plain(rows, facts, keys))
    found = enrich_features(kernel, facts.drop("s"), "k", "f", "ts", max_broadcast_bytes=0)
    assert seen[0] <= 10 * len(keys) + 20
    assert rows(found) == rows(enrich_features(kernel, facts.drop("s"), "k", "f", "ts"))
