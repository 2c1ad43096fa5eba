"""Coverage of a step's output, and the record of the rows that each step dropped."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidescore.functions.columns import as_list, tag_dropped
from tidescore.operators.skew import anti_join
from tidescore.sources.counts import count_rows


class CoverageError(RuntimeError):
    """Too few rows came back from a step."""


class EmptyKernelError(CoverageError):
    """The step had no input rows, so that it has no coverage."""


def coverage(kernel: DataFrame, output: DataFrame, key: str | Sequence[str] | None = None,
             threshold: float = 99.0) -> DataFrame:
    """One row (kernel_count, output_count, pct, passed) from the row counts of both frames.

    Counting rows needs no column and no shuffle. With a ``key`` the row also has matched_count, the kernel
    rows whose key (null equals null) is in the output; that takes a shuffle of both key columns.
    An empty kernel gives a null percentage and does not pass. Whether it passes is decided on whole numbers
    and the threshold's decimal digits, not on the rounded percentage: equal passes.
    """
    if key is None:
        sides = kernel.select(F.lit(1).alias("k")).unionAll(output.select(F.lit(0).alias("k")))
        counts = sides.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("kernel_count"),
                           F.coalesce(F.sum(1 - F.col("k")), F.lit(0)).alias("output_count"))
    else:
        keys = as_list(key)
        sides = (kernel.select(*keys, F.lit(1).alias("k"), F.lit(0).alias("o"))
                 .unionAll(output.select(*keys, F.lit(0), F.lit(1))))
        per_key = sides.groupBy(*keys).agg(F.sum("k").alias("k"), F.sum("o").alias("o"))
        matched = F.sum(F.when(F.col("o") > 0, F.col("k")))
        counts = per_key.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("kernel_count"),
                             F.coalesce(F.sum("o"), F.lit(0)).alias("output_count"),
                             F.coalesce(matched, F.lit(0)).alias("matched_count"))
    return _judged(counts, threshold)


def stored_coverage(spark: SparkSession, kernel: DataFrame | str, output: DataFrame | str,
                    threshold: float = 99.0) -> DataFrame:
    """The row of ``coverage`` for tables or paths given by their names, counted from the footers of their files.

    Either side may also be a frame, which is counted as it is. The two counts come to the driver.
    """
    kernel_count, output_count = count_rows(spark, kernel), count_rows(spark, output)
    counts = spark.range(1).select(F.lit(kernel_count).cast("bigint").alias("kernel_count"),
                                   F.lit(output_count).cast("bigint").alias("output_count"))
    return _judged(counts, threshold)


def _judged(counts: DataFrame, threshold: float) -> DataFrame:
    pct = F.try_divide(F.col("output_count").cast("double"), F.col("kernel_count")) * 100
    needed = F.lit(Decimal(str(threshold))) * F.col("kernel_count")
    enough = (F.col("kernel_count") > 0) & (F.col("output_count") * 100 >= needed)
    return counts.withColumn("pct", pct).withColumn("passed", enough)


def require_coverage(kernel: DataFrame | str, output: DataFrame | str, threshold: float = 99.0, step: str = "step",
                     spark: SparkSession | None = None) -> Row:
    """Run the coverage count, raise if it is under the threshold and return its row otherwise.

    With a session, stored tables can be given by name and are counted as in ``stored_coverage``.
    """
    counts = stored_coverage(spark, kernel, output, threshold) if spark else coverage(kernel, output, threshold=threshold)
    row = counts.first()
    if row.kernel_count == 0:
        raise EmptyKernelError(f"{step}: the input is empty")
    if not row.passed:
        raise CoverageError(f"{step}: {row.output_count} of {row.kernel_count} rows came back "
                            f"({row.pct:.2f} %), {threshold} % are needed")
    return row


def _except(kernel: DataFrame, output: DataFrame, keys: list[str]) -> DataFrame:
    """Every kernel key that the output lacks, once; null equals null.

    One aggregation and no join: repeats are combined before the shuffle, so that a hot key costs one row
    per task on either side.
    """
    sides = (kernel.select(*keys, F.lit(1).alias("side"))
             .unionAll(output.select(*keys, F.lit(2))))
    return (sides.groupBy(*keys).agg(F.bit_or("side").alias("sides"))
            .filter(F.col("sides") == 1).select(*keys))


def _not_in(kernel: DataFrame, output: DataFrame, key: str) -> DataFrame:
    """Kernel keys NOT IN the output, repeats kept: an empty output keeps everything, null keys too, and one
    with a null keeps nothing.

    Spark's own NOT IN broadcasts the output whatever its size. Here the output's rows and nulls are counted
    first, and an ordinary anti-join does the rest.
    """
    counts = output.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("n_known")).first()
    keys = kernel.select(key)
    if counts.n == 0:
        return keys
    if counts.n_known < counts.n:
        return keys.limit(0)
    return anti_join(keys.filter(F.col(key).isNotNull()), output, key, counts.n)


def dropped_rows(kernel: DataFrame, output: DataFrame, key: str | Sequence[str], step: str,
                 priority: float = 1.0, nulls: str = "except") -> DataFrame:
    """Keys of the kernel that the output lacks, as (key, drop_step, priority).

    ``nulls`` picks one of three rules, which differ for repeated and null keys:
    ``except`` gives every missing key once, and null equals null;
    ``sql`` is NOT IN: repeats are kept, and one null key in the output leaves nothing;
    ``keep`` is the anti-join: repeats and null keys are kept.
    """
    keys = as_list(key)
    if nulls == "except":
        missing = _except(kernel, output, keys)
    elif nulls == "sql":
        if len(keys) != 1:
            raise ValueError("NOT IN is defined for one key column")
        missing = _not_in(kernel, output, keys[0])
    elif nulls == "keep":
        missing = anti_join(kernel.select(*keys), output, keys)
    else:
        raise ValueError(f"unknown null rule {nulls!r}: except, sql or keep")
    return tag_dropped(missing, step, priority)


# A row per so many repeats of a key, before they become rows each.
REPEATS = 10_000


def funnel_audit(outputs: Sequence[tuple[str, DataFrame]], key: str, priority: float = 2.0) -> DataFrame:
    """For every step after the first, the keys of the previous output NOT IN its own output; repeats are kept.

    One aggregation counts each key in all outputs, with counts combined before the only shuffle; a key is dropped
    by a step where its count becomes zero, as often as it was there before. NOT IN's rule for nulls and
    empty outputs depends on two numbers of each output, which are counted first without a shuffle of keys.
    """
    if len(outputs) < 2:
        raise ValueError("a funnel needs at least two outputs")
    tagged = reduce(DataFrame.unionAll, [
        output.select(key, F.lit(number).alias("step")) for number, (_, output) in enumerate(outputs)])
    sizes = {row.step: row for row in tagged.groupBy("step").agg(
        F.count(F.lit(1)).alias("n"), F.count(key).alias("n_known")).collect()}
    counts = tagged.groupBy(key).agg(*[
        F.count(F.when(F.col("step") == number, F.lit(1))).alias(f"n_{number}") for number in range(len(outputs))])

    drops = []
    for number, (step, _) in enumerate(outputs):
        if not number or (number in sizes and sizes[number].n_known < sizes[number].n):
            continue
        gone = F.lit(True) if number not in sizes else (F.col(f"n_{number}") == 0) & F.col(key).isNotNull()
        drops.append(F.struct(F.lit(step).alias("drop_step"), F.when(gone, F.col(f"n_{number - 1}")).otherwise(0).alias("n")))
    if not drops:
        return tag_dropped(outputs[0][1].select(key).limit(0), outputs[1][0], priority)
    dropped = (counts.select(key, F.explode(F.array(*drops)).alias("drop")).filter("drop.n > 0")
               .select(key, "drop.drop_step", "drop.n"))
    # A key's repeats become rows in two stages, so that no array grows with them.
    parts = dropped.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {REPEATS}"))))
    size = F.least(F.lit(REPEATS), F.col("n") - F.col("part") * REPEATS).cast("int")
    return parts.select(key, "drop_step", F.explode(F.array_repeat(F.lit(float(priority)), size)).alias("priority"))


def validate_results(kernel: DataFrame, output: DataFrame, key: str | Sequence[str], step: str,
                     threshold: float = 99.0):
    """Check a model's coverage; return its row and the frame of dropped keys (priority 1).

    The drop step is ``model_<step>``. Below the threshold this raises before any drop is recorded.
    """
    row = require_coverage(kernel, output, threshold, step)
    return row, dropped_rows(kernel, output, key, f"model_{step}", 1.0, "except")
