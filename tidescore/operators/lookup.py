"""Joins that add columns to keyed rows: predictions, and late results of a work list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescore.functions.columns import as_list
from tidescore.operators.skew import MAX_KEY_ROWS, left_join


def join_result(kernel: DataFrame, predictions: DataFrame, key: str | Sequence[str],
                features: str | Sequence[str] = (), *, broadcast: bool = True,
                max_key_rows: int | None = MAX_KEY_ROWS) -> DataFrame:
    """Add the prediction columns to the kernel rows.

    The model's feature columns are dropped from the predictions first; names that are absent are
    ignored. Kernel rows without a prediction stay, with nulls, and repeated predictions repeat the row.
    Predictions of small measured size are broadcast, unless ``broadcast`` is off.
    """
    keys = as_list(key)
    predictions = predictions.drop(*[name for name in as_list(features) if name not in keys])
    shared = [name for name in predictions.columns if name in kernel.columns and name not in keys]
    if shared:
        raise ValueError(f"columns on both sides: {shared}; list them as features to drop them")
    return left_join(kernel, predictions, keys, max_key_rows, broadcast)


def fill_missing(base: DataFrame, updates: DataFrame, key: str | Sequence[str],
                 columns: str | Sequence[str], *, max_key_rows: int | None = MAX_KEY_ROWS) -> DataFrame:
    """Fill nulls of the base from the updates; values that are there stay, unknown update keys are ignored."""
    keys, filled = as_list(key), as_list(columns)
    renamed = updates.select(*keys, *[F.col(name).alias(f"_new_{name}") for name in filled])
    joined = left_join(base, renamed, keys, max_key_rows)
    return joined.select(*[
        F.coalesce(F.col(name), F.col(f"_new_{name}")).alias(name) if name in filled else F.col(name)
        for name in base.columns
    ])
