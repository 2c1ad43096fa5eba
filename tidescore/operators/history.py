"""The history table: every run's rows, appended under their execution date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame

from tidescore.functions.columns import add_nulls, as_list, choose, nullify, stamp_run
from tidescore.operators.once import append_once
from tidescore.sources.scratch import apart
from tidescore.sources.tables import store, table_exists

DATE = "execution_date"
RUN = "run_type"


def history_rows(df: DataFrame, run_type: str | None = None, execution_date=None, *,
                 columns: str | Sequence[str | Column] | None = None,
                 nulls: Mapping[str, str] | None = None) -> DataFrame:
    """The rows as the history stores them: chosen columns, run stamp, typed nulls, blanks as null.

    The columns are chosen before stamping, so a given date or run type is never lost.
    """
    return nullify(add_nulls(stamp_run(choose(df, columns), run_type, execution_date, DATE), nulls))


def append_to_history(df: DataFrame, table: str, run_type: str | None = None, execution_date=None, *,
                      columns: str | Sequence[str | Column] | None = None, nulls: Mapping[str, str] | None = None,
                      sort_by: str | Sequence[str] | None = None, replace_run: bool = False,
                      run: str | None = None) -> None:
    """Append a run to the history table, partitioned by execution date.

    Rows whose dates come from a column are brought together by date first; adaptive execution splits the
    tasks of large dates and leaves small ones apart, which are written side by side. Under one given date the rows are dealt out evenly, to as many tasks as their size
    needs, so that a few rows left in many tasks do not become as many files. ``sort_by`` sorts the rows of each
    file, which narrows its column statistics.

    A plain append run twice stores its rows twice. With the name of a ``run`` it takes place once for that run, however
    often it is tried and wherever it breaks off. ``replace_run`` makes the run's rows replace those
    stored under the same date and run type. Both must be given, and the table is partitioned by both.
    """
    if replace_run and not (run_type and execution_date):
        raise ValueError("replace_run needs a run type and an execution date")
    rows = history_rows(df, run_type, execution_date, columns=columns, nulls=nulls)
    rows = rows.hint("rebalance") if execution_date else rows.hint("rebalance", DATE)
    rows = rows.sortWithinPartitions(DATE, *as_list(sort_by)) if sort_by or not execution_date else rows
    if not replace_run:
        with nullcontext() if execution_date else apart(df.sparkSession):
            if run is None:
                store(rows, table, "append", DATE)
            else:
                append_once(rows, table, run, DATE)
        return
    spark = df.sparkSession
    if not table_exists(spark, table):
        store(rows, table, "append", [DATE, RUN])
        return
    partitions = [column.name for column in spark.catalog.listColumns(table) if column.isPartition]
    if partitions != [DATE, RUN]:
        raise ValueError(f"{table} is partitioned by {partitions}; replace_run needs {[DATE, RUN]}")
    stored = ["`" + name.replace("`", "``") + "`" for name in spark.table(table).columns if name not in partitions]
    run = run_type.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({DATE} = '{execution_date}', {RUN} = '{run}') "
              f"SELECT {', '.join(stored)} FROM {{rows}}", rows=rows)
