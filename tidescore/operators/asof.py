"""Latest-before feature lookup: every kernel row gets its key's last feature row up to its own time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidescore.functions.columns import any_null, as_list, orderable
from tidescore.operators.skew import MAX_KEY_ROWS, among_keys, broadcast_if_small, hot_keys, is_small, stored


# Rows that one task sorts at least, where long keys are cut into ranges.
TASK_ROWS = 100_000


def enrich_features(kernel: DataFrame, features_df: DataFrame, key: str | Sequence[str],
                    features: str | Sequence[str], kernel_ts: str, feature_ts: str | None = None,
                    min_date=None, *, max_key_rows: int | None = MAX_KEY_ROWS,
                    max_broadcast_bytes: int | None = None) -> DataFrame:
    """Add the feature columns of the key's latest feature row at or before the kernel time.

    Of several feature rows at one time the greatest value tuple counts; maps and variants have no order and
    do not decide. ``min_date`` leaves older feature rows out. Kernel rows without a feature row, or with a null key or time, stay, with null features.

    Both sides are sorted together once per key. Keys with more than ``max_key_rows`` rows on both sides
    together are sorted by ranges of (key, time) instead, over as many tasks as their rows need; the limit says how
    many rows a range has, not how many a task has. The ranges are stored in the shared folder, which the result reads from. One pass counts the rows of both sides; keys
    are counted only if the rows are enough for a long one.

    Feature rows of other keys are left out before anything is shuffled: by the kernel's keys where they are small enough to
    be broadcast (``max_broadcast_bytes``, 64 MB by default), and else, if there are fewer kernel rows than feature rows, by a
    bitmap of fixed size of those keys.
    """
    keys, names = as_list(key), as_list(features)
    feature_ts = feature_ts or kernel_ts
    clash = [name for name in names if name in kernel.columns]
    if clash:
        raise ValueError(f"the kernel already has columns {clash}")
    columns = kernel.columns

    facts = (features_df
             .select(*keys, F.col(feature_ts).alias("_ts"), F.struct(*names).alias("_feat"),
                     F.struct(*(orderable(features_df.schema, names) or [F.lit(0)])).alias("_order"))
             .filter(~any_null(keys) & F.col("_ts").isNotNull()))
    if min_date is not None:
        facts = facts.filter(F.col("_ts") >= F.lit(min_date).cast(facts.schema["_ts"].dataType))
    unusable = any_null(keys) | F.col(kernel_ts).isNull()
    rows = (kernel.filter(~unusable)
            .select(*keys, F.col(kernel_ts).alias("_ts"), F.struct(*columns).alias("_row")))
    wanted = rows.select(*keys)
    sides = kernel.select(F.lit(1).alias("k")).unionAll(features_df.select(F.lit(0)))
    n_both, n_kernel = sides.agg(F.count("k"), F.coalesce(F.sum("k"), F.lit(0))).first()
    hot = hot_keys(wanted.unionAll(facts.select(*keys)), keys, max_key_rows, n_both)
    if is_small(wanted, max_broadcast_bytes, rows=n_kernel):
        facts = facts.join(F.broadcast(wanted), keys, "left_semi")
    elif 2 * n_kernel < n_both:
        facts = among_keys(facts, wanted, keys)

    if hot is None:
        found = _by_key(rows, facts, keys)
    else:
        listed = broadcast_if_small(hot.select(*keys))
        found = _by_key(rows.join(listed, keys, "left_anti"), facts.join(listed, keys, "left_anti"), keys)
        n_hot = hot.agg(F.sum("n_rows")).first()[0]
        found = found.unionAll(_by_range(rows.join(listed, keys, "left_semi"),
                                         facts.join(listed, keys, "left_semi"), keys, n_hot, max_key_rows))
    types = dict(zip(names, (features_df.schema[name].dataType for name in names)))
    unfound = kernel.filter(unusable).select(
        *columns, *[F.lit(None).cast(types[name]).alias(name) for name in names])
    return found.select("_row.*", *[F.col(f"_feat.{name}").alias(name) for name in names]).unionAll(unfound)


def _side_by_side(rows: DataFrame, facts: DataFrame, keys: list[str], payload: str | None) -> DataFrame:
    """Facts (kind 0) and rows to look up (kind 1) in one frame; at equal times facts sort first."""
    nothing = [F.lit(None).cast(facts.schema[name].dataType).alias(name) for name in ("_feat", "_order")]
    left = facts.select(*keys, "_ts", F.lit(0).alias("_kind"), "_feat", "_order")
    right = rows.select(*keys, "_ts", F.lit(1).alias("_kind"), *nothing, *([payload] if payload else []))
    if payload:
        left = left.withColumn(payload, F.lit(None).cast(rows.schema[payload].dataType))
    return left.unionByName(right)


def _by_key(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """One shuffle and one sort per key: (_row, _feat)."""
    so_far = (Window.partitionBy(*keys).orderBy("_ts", "_kind", "_order")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = _side_by_side(rows, facts, keys, "_row")
    return (both.withColumn("_feat", F.last("_feat", ignorenulls=True).over(so_far))
            .filter(F.col("_kind") == 1).select("_row", "_feat"))


def _by_range(rows: DataFrame, facts: DataFrame, keys: list[str], n_rows: int, most: int) -> DataFrame:
    """The same for keys too long for one window: (_row, _feat).

    One fact and one lookup per (key, time) are range partitioned by them and sorted, and every ``most`` rows of a
    partition are a piece, so that a low limit makes many pieces but not many tasks. Each piece is filled on its own; what it lacks at its start comes from the last
    fact of the key's earlier pieces, of which there is one row each.
    """
    facts = facts.groupBy(*keys, "_ts").agg(F.max_by("_feat", "_order").alias("_feat"), F.max("_order").alias("_order"))
    lookups = rows.select(*keys, "_ts").distinct()
    tasks, most = -(-n_rows // max(most, TASK_ROWS)), max(most, 1)
    place = F.monotonically_increasing_id()  # the partition, and the row's place there in the lower 33 bits
    cut = (_side_by_side(lookups, facts, keys, None)
           .repartitionByRange(tasks, *keys, "_ts", "_kind").sortWithinPartitions(*keys, "_ts", "_kind")
           .withColumn("_piece", place)
           .withColumn("_piece", F.col("_piece") - F.col("_piece").bitwiseAND(F.lit(2**33 - 1)) % most))
    # Stored, because the piece numbers hold only within the one job that computed the ranges.
    cut = stored(cut.drop("_order"))

    within = (Window.partitionBy(*keys, "_piece").orderBy("_ts", "_kind")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    earlier = (Window.partitionBy(*keys).orderBy("_piece")
               .rowsBetween(Window.unboundedPreceding, -1))
    ends = cut.groupBy(*keys, "_piece").agg(
        F.max_by("_feat", F.when(F.col("_kind") == 0, F.col("_ts"))).alias("_end"))
    carried = ends.select(*keys, "_piece", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    answers = (cut.withColumn("_feat", F.last("_feat", ignorenulls=True).over(within))
               .filter(F.col("_kind") == 1)
               .join(carried, [*keys, "_piece"], "left")
               .select(*keys, "_ts", F.coalesce("_feat", "_carried").alias("_feat")))
    return rows.join(answers, [*keys, "_ts"], "left").select("_row", "_feat")
