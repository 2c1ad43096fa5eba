"""Column-level building blocks: projections, stamps, null handling, date rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_list(names: str | Sequence[str] | None) -> list[str]:
    """One name, a comma separated string or a sequence, as a list without repeats."""
    if names is None:
        return []
    if isinstance(names, str):
        names = [part.strip() for part in names.split(",")]
    return list(dict.fromkeys(name for name in names if name))


def choose(df: DataFrame, columns: str | Sequence[str | Column] | None) -> DataFrame:
    """The chosen columns, given as names or as expressions, or the frame as it is."""
    if not columns:
        return df
    return df.select(*(as_list(columns) if isinstance(columns, str) else columns))


def any_null(key: str | Sequence[str]) -> Column:
    """True where at least one key column is null, so that the row can match nothing."""
    columns = as_list(key)
    test = F.col(columns[0]).isNull()
    for name in columns[1:]:
        test = test | F.col(name).isNull()
    return test


def orderable(schema: T.StructType, names: Sequence[str]) -> list[str]:
    """Those of the columns whose values have an order; maps and variants, also inside other types, have none."""
    def ordered(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return ordered(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(ordered(field.dataType) for field in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return [name for name in names if ordered(schema[name].dataType)]


def project_features(df: DataFrame, key: str | Sequence[str], features: str | Sequence[str]) -> DataFrame:
    """Key and feature columns, each once, also where the key is listed as a feature."""
    return df.select(*as_list([*as_list(key), *as_list(features)]))


def stamp_run(df: DataFrame, run_type: str | None = None, execution_date=None,
              date_column: str = "execution_date") -> DataFrame:
    """Stamp the run type, and the run date as a date.

    Without ``execution_date`` the frame's own date column is cast to a date; it has to exist.
    """
    if run_type:
        df = df.withColumn("run_type", F.lit(run_type))
    if execution_date:
        return df.withColumn(date_column, F.lit(execution_date).cast("date"))
    if date_column not in df.columns:
        raise ValueError(f"no execution date given and no column {date_column!r} to take it from")
    return df.withColumn(date_column, F.col(date_column).cast("date"))


def cast_date_if_present(df: DataFrame, date_column: str = "execution_date") -> DataFrame:
    if date_column not in df.columns:
        return df
    return df.withColumn(date_column, F.col(date_column).cast("date"))


def add_date_updated(df: DataFrame, now=None, column: str = "date_updated") -> DataFrame:
    """Add the update time unless the frame has one; ``now`` fixes it for repeatable runs."""
    if column in df.columns:
        return df
    value = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return df.withColumn(column, value)


def add_nulls(df: DataFrame, columns: Mapping[str, str] | None) -> DataFrame:
    """Add columns of typed nulls, given as name -> type."""
    for name, data_type in (columns or {}).items():
        df = df.withColumn(name, F.lit(None).cast(data_type))
    return df


def nullify(df: DataFrame) -> DataFrame:
    """Blank strings become null in every string column; other values stay as they are."""
    return df.select(*[
        F.when(F.trim(F.col(f"`{field.name}`")) != "", F.col(f"`{field.name}`")).alias(field.name)
        if isinstance(field.dataType, T.StringType) else F.col(f"`{field.name}`")
        for field in df.schema.fields
    ])


def cap_rows(df: DataFrame, n: int | None) -> DataFrame:
    """At most ``n`` arbitrary rows for sandbox runs; None or a negative number is no cap, 0 is none at all."""
    return df if n is None or n < 0 else df.limit(n)


def tag_dropped(keys: DataFrame, step: str, priority: float) -> DataFrame:
    """Audit columns of dropped rows; the priority is a double for every writer."""
    return keys.withColumn("drop_step", F.lit(step)).withColumn("priority", F.lit(float(priority)))


def newer(new_dates: Sequence[Column], old_dates: Sequence[Column]) -> Column:
    """True where the first non-null new date is after the first non-null old date.

    Null where either side has no date, so a filter or ``when`` keeps the old row, as it does for ties.
    """
    return F.coalesce(*new_dates) > F.coalesce(*old_dates)


def epoch_ms_to_ntz(ms: Column) -> Column:
    """Epoch milliseconds as a timestamp without zone, exact to the millisecond."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("MILLISECOND", ms.cast("bigint"), epoch)
