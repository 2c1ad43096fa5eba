"""The wide table: one current row per key, where the newest date wins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidescore.functions.columns import (
    add_date_updated,
    any_null,
    as_list,
    cast_date_if_present,
    choose,
    newer,
    orderable,
)
from tidescore.operators.skew import is_small
from tidescore.sources.commits import Change, Log
from tidescore.sources.scratch import apart, scratch, stage
from tidescore.sources.tables import drop_tables, ensure_table, get_property, load, set_properties, table_exists

BUCKET = "wt_bucket"
# Table properties: the number of buckets, and a stored merge that an earlier version of this library left to be put in place.
BUCKETS_PROPERTY, PENDING_PROPERTY = "wide.buckets", "wide.pending"
# How many runs the record of a merge remembers.
REMEMBERED_RUNS = 1000


class DuplicateKeyError(ValueError):
    """Several delta rows match one row of the wide table."""


class ConcurrentMergeError(RuntimeError):
    """Another merge changed the table while this one was computed; nothing of this one was stored."""


def newest_per_key(delta: DataFrame, key: str | Sequence[str], date_columns: str | Sequence[str]) -> DataFrame:
    """One row per non-null key: the newest date, then the greatest values. Rows with a null key all stay.

    Columns without an order, maps and variants, do not decide; of rows that differ only there any one counts.
    """
    keys, dates = as_list(key), as_list(date_columns)
    rest = [name for name in delta.columns if name not in keys]
    order = F.struct(F.coalesce(*[F.col(name) for name in dates]).alias("_date"),
                     *[F.col(name) for name in orderable(delta.schema, rest)])
    best = (delta.filter(~any_null(keys)).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"))
            .select(*[F.col(name) if name in keys else F.col(f"_best.{name}") for name in delta.columns]))
    return best.unionAll(delta.filter(any_null(keys)))


def _refuse_matched_repeats(target: DataFrame, delta: DataFrame, keys: list[str]) -> None:
    """Raise if a key that the delta repeats is in the target."""
    repeated = (delta.select(*keys).filter(~any_null(keys)).groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(*keys))
    hit = target.select(*keys).join(repeated, keys, "left_semi").limit(1).collect()
    if hit:
        raise DuplicateKeyError(f"several delta rows for key {tuple(hit[0])} of the wide table")


def _delta_stats(delta: DataFrame, keys: list[str], group: Column) -> list[Row]:
    """Per group the delta's rows and the most rows of one non-null key, from one pass over the keys."""
    per_key = delta.select(*keys, group.alias("group")).groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("group").agg(
        F.sum("n").alias("n_rows"), F.max(F.when(~any_null(keys), F.col("n"))).alias("most")).collect()


def upsert_newest(target: DataFrame, delta: DataFrame, key: str | Sequence[str],
                  date_columns: str | Sequence[str] = "execution_date", *,
                  on_duplicate: str = "error") -> DataFrame:
    """The target after merging in the delta, with the target's columns.

    A matched row takes all the delta's values if the delta's first non-null date is after the target's;
    otherwise, also for equal or null dates, it stays. Unmatched delta rows are added, and those with a
    null key never match. ``on_duplicate`` says what several delta rows for one key do: ``error`` raises if
    the target has the key (and adds them all if it has not), ``newest`` keeps the newest of them.

    The delta's values have to fit the target's types without loss: a wider number or a text for a number is
    refused, a narrower number is widened.

    A small delta is broadcast and the target is not shuffled. A large one is joined by a left join, whose
    hot target keys adaptive execution can split, and not by a full outer join, where it cannot.
    """
    keys, dates = as_list(key), as_list(date_columns)
    delta = as_target(target, delta)
    stats = _delta_stats(delta, keys, F.lit(0))
    return _merge(target, delta, keys, dates, on_duplicate, stats)


WIDER = {"tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "float": 5, "double": 6}
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def _fits(kind: T.DataType, target: T.DataType) -> bool:
    """Whether every value of one type is stored in the other as the same value."""
    name, wanted = kind.simpleString(), target.simpleString()
    if name == wanted or isinstance(kind, T.NullType):
        return True
    if isinstance(target, T.DecimalType):
        whole = target.precision - target.scale
        if isinstance(kind, T.DecimalType):
            return kind.scale <= target.scale and kind.precision - kind.scale <= whole
        return DIGITS.get(name, whole + 1) <= whole
    if name in WIDER and wanted in WIDER:
        exact = wanted == "double" and name in ("tinyint", "smallint", "int", "float")
        small = wanted == "float" and name in ("tinyint", "smallint")
        return exact or small or (wanted in DIGITS and name in DIGITS and WIDER[name] < WIDER[wanted])
    return isinstance(kind, T.DateType) and wanted in ("timestamp", "timestamp_ntz")


def as_target(target: DataFrame, delta: DataFrame) -> DataFrame:
    """A frame with another's columns and types, taken by name; a type that may lose something is refused."""
    absent = [name for name in target.columns if name not in delta.columns]
    if absent:
        raise ValueError(f"the frame lacks columns of the target: {absent}")
    for field in target.schema.fields:
        kind = delta.schema[field.name].dataType
        if not _fits(kind, field.dataType):
            raise ValueError(f"{field.name}: {kind.simpleString()} does not fit {field.dataType.simpleString()}")
    return delta.select(*[F.col(f"`{field.name}`").cast(field.dataType).alias(field.name)
                          for field in target.schema.fields])


def _merge(target: DataFrame, delta: DataFrame, keys: list[str], dates: list[str], on_duplicate: str,
           stats: Sequence[Row]) -> DataFrame:
    if on_duplicate not in ("error", "newest"):
        raise ValueError(f"unknown duplicate rule {on_duplicate!r}: error or newest")
    if any((row.most or 0) > 1 for row in stats):
        if on_duplicate == "newest":
            delta = newest_per_key(delta, keys, dates)
        else:
            _refuse_matched_repeats(target, delta, keys)

    small = is_small(delta, rows=sum(row.n_rows for row in stats))
    known = delta.filter(~any_null(keys))
    # Repeats can only be of keys that the target lacks, so they cannot multiply a target row.
    incoming = known.select(*keys, F.struct(*target.columns).alias("_new"))
    joined = target.join(F.broadcast(incoming) if small else incoming, keys, "left")
    take = F.coalesce(newer([F.col(f"_new.{name}") for name in dates], [F.col(name) for name in dates]),
                      F.lit(False))
    kept = joined.select(*[_pick(take, name, [*keys, BUCKET]) for name in target.columns])

    if small:
        matched = target.select(*keys).join(F.broadcast(known.select(*keys)), keys, "left_semi").distinct()
        added = known.join(matched, keys, "left_anti")
    else:
        added = known.join(target.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(added).unionByName(delta.filter(any_null(keys)))


def _pick(take: Column, name: str, unchanged: list[str]) -> Column:
    if name in unchanged:
        return F.col(name)
    return F.when(take, F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name)


def _with_bucket(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Bucket by key; rows with a null key match nothing and are spread by their other values.

    Keys whose equality is not that of their bytes are refused, since the bucket is a hash of the bytes.
    """
    for name in keys:
        if "collate" in df.schema[name].dataType.simpleString():
            raise ValueError(f"key {name} has a collation; use its lower-case form or another plain text as the key")
    others = [F.col(name) for name in orderable(df.schema, [name for name in df.columns if name not in keys])] or [F.lit(0)]
    spread = F.when(any_null(keys), F.xxhash64(*others)).otherwise(F.xxhash64(*keys))
    return df.withColumn(BUCKET, F.pmod(spread, F.lit(buckets)).cast("int"))


def read_wide(spark: SparkSession, name: str) -> DataFrame:
    """The wide table without its storage column. A merge that broke off while its files moved is finished first."""
    log = Log(spark, name, "merges")
    if version := _version(log):
        log.finish(_record(version))
    return load(spark, name).drop(BUCKET)


def merge_into_wide(spark: SparkSession, name: str, delta: DataFrame, key: str | Sequence[str],
                    date_columns: str | Sequence[str] = "execution_date", *,
                    select_fields: str | Sequence[str | Column] | None = None, date_updated: bool = False,
                    now=None, on_duplicate: str = "error", buckets: int = 256, stored: bool = False,
                    staged: bool = True, properties: Mapping[str, str] | None = None, run: str | None = None) -> None:
    """Merge a delta into a wide table, creating the table from the delta if it does not exist.

    The table is partitioned by a hash bucket of the key, and a merge reads and rewrites only the buckets
    that the delta falls in. ``buckets`` is fixed at creation; a delta should touch few of them, so choose
    more buckets for small deltas on a large table.

    The new content of the touched buckets is written in full inside the table's folder, where no reader looks. A
    record numbered one above the last then names the new files and those they replace, and is created only if there is
    none of that number; after it, files move and nothing is written again. Of two merges that began at the same state, in
    one process or in several, one therefore raises ``ConcurrentMergeError`` and leaves no trace. A merge that
    breaks off before its record has not taken place, and one that breaks off after it is finished by the next merge or
    ``read_wide``, which can be repeated without harm.

    A merge with the same ``run`` as one of the last thousand has taken place already and does nothing.

    The delta is read several times and is therefore first written to the shared folder, unless ``stored``
    says that it comes straight from a stored table other than this one. ``select_fields`` may hold
    expressions, and ``properties`` are given to the table when it is created. ``staged`` has no effect any more, since
    buckets are written once in any case.
    """
    keys, dates = as_list(key), as_list(date_columns)
    delta = cast_date_if_present(choose(delta, select_fields))
    if date_updated:
        # One value for the whole merge, however often the delta is read.
        now = spark.range(1).select(F.current_timestamp()).first()[0] if now is None else now
        delta = add_date_updated(delta, now)

    first = None
    if not table_exists(spark, name):
        first = _with_bucket(delta, keys, buckets)
        ensure_table(spark, name, first.schema, partition_by=BUCKET, options={"partitionOverwriteMode": "dynamic"},
                     properties={**(properties or {}), BUCKETS_PROPERTY: str(buckets)})
    log = Log(spark, name, "merges")
    version, runs = _settled(spark, log)
    if run is not None and run in runs:
        return
    runs = [*runs, run][-REMEMBERED_RUNS:] if run is not None else runs
    if first is not None and not version:
        with apart(spark):
            change = log.stage(first.hint("rebalance", BUCKET), BUCKET)
        _replace(log, version, runs, change)
        return

    buckets = get_property(spark, name, BUCKETS_PROPERTY)
    if buckets is None:
        raise ValueError(f"{name} was not created as a wide table")
    current = load(spark, name)
    delta = _with_bucket(as_target(current.drop(BUCKET), delta), keys, int(buckets))
    with ExitStack() as temporary:
        if not stored:
            delta = stage(delta, temporary.enter_context(scratch(spark, "merge")), "delta")
        stats = _delta_stats(delta, keys, F.col(BUCKET))
        if not stats:
            return
        touched = [row.group for row in stats]
        old = log.listed(f"{BUCKET}={bucket}" for bucket in touched)
        within = F.col(BUCKET).isin(touched)
        try:
            merged = _merge(current.filter(within), delta, keys, dates, on_duplicate, stats)
            with apart(spark):
                change = log.stage(merged.hint("rebalance", BUCKET), BUCKET)
        except Exception as error:
            if _version(log) != version:  # the files that it read may be gone
                raise ConcurrentMergeError(f"{name} was changed by another merge") from error
            raise
        change.remove = old
        _replace(log, version, runs, change)


def _record(version: int) -> str:
    return f"{version:012d}"


def _version(log: Log) -> int:
    """How many merges there were."""
    return max(map(int, log.names()), default=0)


def _settled(spark: SparkSession, log: Log) -> tuple[int, list[str]]:
    """Finish the last merge; its number, and the last merges' runs."""
    _finish_pending(spark, log.table)
    version = _version(log)
    if not version:
        return 0, []
    log.finish(_record(version))
    spark.catalog.refreshTable(log.table)  # another process may have finished it
    return version, log.says(_record(version)).get("runs", [])


def _replace(log: Log, version: int, runs: list[str], change: Change) -> None:
    """Put a merge in place that began when there were so many merges."""
    change.says = {"runs": runs}
    if not log.commit(_record(version + 1), change):
        raise ConcurrentMergeError(f"{log.table} was changed by another merge")
    log.finish(_record(version + 1))


def _finish_pending(spark: SparkSession, name: str) -> None:
    """Put in place what an earlier version of this library stored as a table and named in a property."""
    pending = get_property(spark, name, PENDING_PROPERTY)
    if not pending:
        return
    if table_exists(spark, pending):
        load(spark, pending).write.mode("overwrite").insertInto(name)
    set_properties(spark, name, {PENDING_PROPERTY: ""})
    drop_tables(spark, [pending])
