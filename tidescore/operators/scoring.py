"""Scoring a keyed frame with a model that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tidescore.functions.columns import as_list, project_features

Predict = Callable[[pd.DataFrame], pd.DataFrame]

# Whole numbers and booleans keep their values next to nulls.
NULLABLE = {
    pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
    pa.bool_(): pd.BooleanDtype(),
}


def score(df: DataFrame, key: str | Sequence[str], features: str | Sequence[str],
          load_model: Callable[[], Predict], predictions: str | T.StructType) -> DataFrame:
    """Key, features and the model's prediction columns.

    ``load_model`` runs once per task and returns a function from a batch of features to a batch of
    predictions, matched by index; rows that it leaves out are not in the result. The frame reaches Python
    in Arrow batches, so memory does not depend on the size of a partition. Only key and feature columns are
    read.

    Key and feature columns are passed on as they came; only the model's copy of the features is pandas. There,
    whole numbers and booleans have pandas' nullable types, and timestamps with a zone are in UTC.
    """
    keys, names = as_list(key), as_list(features)
    projected = project_features(df, keys, names)
    added = T.StructType.fromDDL(predictions) if isinstance(predictions, str) else predictions
    new_fields = list(df.sparkSession.createDataFrame([], added).toArrow().schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = load_model()
        for batch in batches:
            found = predict(batch.select(names).to_pandas(types_mapper=NULLABLE.get))
            found = found[found.index.isin(range(batch.num_rows))]
            kept = batch.take(pa.array(found.index.to_numpy(dtype="int64")))
            new = [pa.array(found[field.name], field.type, from_pandas=True) for field in new_fields]
            yield pa.RecordBatch.from_arrays([*kept.columns, *new],
                                             [*kept.schema.names, *(field.name for field in new_fields)])

    return projected.mapInArrow(run, T.StructType(projected.schema.fields + added.fields))


def score_with_columns(df: DataFrame, key: str | Sequence[str], features: str | Sequence[str],
                       predictions: Mapping[str, Column]) -> DataFrame:
    """The same for a model that is a column expression, which never leaves the JVM."""
    return project_features(df, key, features).withColumns(dict(predictions))
