"""Joins that stay even when one key holds a large share of the rows, and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidescore.functions.columns import any_null, as_list
from tidescore.sources.scratch import shared_dir

# A key with more rows than this is handled by splitting it over tasks.
MAX_KEY_ROWS = 1_000_000
# Nothing larger than this is broadcast by our own hints.
MAX_BROADCAST_BYTES = 64 << 20

# Bits of the bitmap by which rows are told apart from those of other keys: 32 MB at most, whatever the number of keys.
KEY_BITS = 28

FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType,
         T.YearMonthIntervalType, T.NullType)


def _measurable(kind: T.DataType) -> bool:
    """Whether the size of values of this type is known or can be measured, also inside other types."""
    if isinstance(kind, T.ArrayType):
        return _measurable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _measurable(kind.keyType) and _measurable(kind.valueType)
    if isinstance(kind, T.StructType):
        return all(_measurable(field.dataType) for field in kind.fields)
    return isinstance(kind, (*FIXED, T.StringType, T.BinaryType))


def _bytes_of(field: T.StructField) -> Column:
    name = F.col(f"`{field.name}`")
    if isinstance(field.dataType, FIXED):
        return F.lit(16)
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 16


def is_small(df: DataFrame, max_bytes: int | None = None, rows: int | None = None) -> bool:
    """Whether the frame's measured size is within the broadcast bound.

    The row count, which the caller may know, settles it for large frames without reading a column. A frame
    with a column whose size cannot be measured is not small.
    """
    max_bytes = MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    if not _measurable(df.schema):
        return False
    rows = df.count() if rows is None else rows
    if rows * 16 * len(df.columns) > max_bytes:
        return False
    if all(isinstance(field.dataType, FIXED) for field in df.schema.fields):
        return True
    sizes = [_bytes_of(field) for field in df.schema.fields]
    total = sizes[0]
    for size in sizes[1:]:
        total = total + size
    return (df.agg(F.sum(total)).first()[0] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Hint a broadcast where the measured size allows it; otherwise leave the join to Spark."""
    return F.broadcast(df) if is_small(df, max_bytes) else df


def stored(df: DataFrame) -> DataFrame:
    """The frame's rows as they are now, in the shared folder: every later read gets the same ones."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def hot_keys(df: DataFrame, key: str | Sequence[str], max_key_rows: int | None = MAX_KEY_ROWS,
             rows: int | None = None) -> DataFrame | None:
    """The keys with more than ``max_key_rows`` rows and their row counts, or None if there are none.

    The keys are counted exactly, with counts combined before the shuffle, and the list stays in the shared
    folder. A limit of None is the caller's word that no key is hot, and a known row count within the limit
    shows it; nothing is counted then.
    """
    keys = as_list(key)
    if max_key_rows is None or (rows is not None and rows <= max_key_rows):
        return None
    found = (df.select(*keys).filter(~any_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
             .filter(F.col("n_rows") > max_key_rows))
    found = stored(found)
    return None if found.isEmpty() else found


def left_join(left: DataFrame, right: DataFrame, key: str | Sequence[str],
              max_key_rows: int | None = MAX_KEY_ROWS, broadcast: bool = True) -> DataFrame:
    """Left equi-join that also copes with keys repeated very often on the right.

    A right side of small measured size is broadcast, unless ``broadcast`` is off. Otherwise both sides are
    shuffled. Adaptive execution then splits a hot key of the left side, but of a left join's right side it
    cannot. The rows of hot right keys are therefore stored and joined apart, by an inner join, which can be
    split on both sides; left rows that find none of the stored rows are added.
    """
    keys = as_list(key)
    rows = right.count()
    if broadcast and is_small(right, rows=rows):
        return left.join(F.broadcast(right), keys, "left")
    hot = hot_keys(right, keys, max_key_rows, rows)
    if hot is None:
        return left.join(right, keys, "left")
    listed = broadcast_if_small(hot.select(*keys))
    many = stored(right.join(listed, keys, "left_semi"))
    there = broadcast_if_small(stored(many.select(*keys).distinct()))
    few = right.join(listed, keys, "left_anti")
    cold_rows = left.join(there, keys, "left_anti").join(few, keys, "left")
    hot_rows = left.join(there, keys, "left_semi").join(many, keys, "inner")
    return cold_rows.unionByName(hot_rows)


def anti_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], rows: int | None = None) -> DataFrame:
    """Left rows without a partner. Repeated left rows and left rows with a null key are kept.

    A right side that a known row count, ``rows``, shows to be small is broadcast. Otherwise each right key is
    needed only once: repeats are combined before the shuffle, and the keys are stored, so that adaptive
    execution can split hot left keys.
    """
    keys = as_list(key)
    right = right.select(*keys)
    if rows is not None and is_small(right, rows=rows):
        return left.join(F.broadcast(right), keys, "left_anti")
    return left.join(stored(right.distinct()), keys, "left_anti")


def among_keys(df: DataFrame, wanted: DataFrame, key: str | Sequence[str], bits: int = KEY_BITS) -> DataFrame:
    """The rows whose key is in the other frame, and some whose key is not; rows with a null key may go.

    The keys are marked by hash in a bitmap of fixed size, which is broadcast in parts of 4 kB. So this costs a shuffle
    of numbers on the side of the keys and none of the rows, and keeps a row of another key with a chance of the
    number of keys divided by that of bits. Keys whose type differs between the frames, or whose equality is not that of
    their bytes, are not told apart.
    """
    keys = as_list(key)
    kinds = [(df.schema[name].dataType, wanted.schema[name].dataType) for name in keys]
    if any(one != other or "collate" in one.simpleString() for one, other in kinds):
        return df
    slot = F.pmod(F.xxhash64(*keys), F.lit(1 << bits)) + 1  # Spark's bitmaps count from 1
    part, place = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    # Each part is made by one task, so no task holds more than its own.
    maps = (wanted.select(part.alias("_part"), place.alias("_place")).repartition("_part")
            .groupBy("_part").agg(F.bitmap_construct_agg(F.col("_place")).alias("_bits")))
    marked = df.withColumns({"_part": part, "_place": place}).join(F.broadcast(maps), "_part")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    inside = F.when(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << bit) for bit in range(8)]),
                                                 (F.col("_place") % 8 + 1).cast("int"))) != 0, True).otherwise(False)
    return marked.filter(inside).select(*df.columns)
