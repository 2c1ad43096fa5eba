"""Storing one result in any of its places: history, wide table, events."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tidescore.operators.history import append_to_history
from tidescore.operators.outbox import events_to_write, write_events
from tidescore.operators.wide import merge_into_wide
from tidescore.sources.scratch import scratch, stage


@dataclass(frozen=True)
class History:
    table: str
    columns: Sequence[str | Column] | None = None
    nulls: Mapping[str, str] | None = None
    sort_by: Sequence[str] | None = None
    replace_run: bool = False


@dataclass(frozen=True)
class Wide:
    table: str
    date_columns: str | Sequence[str] = "execution_date"
    select_fields: Sequence[str | Column] | None = None
    date_updated: bool = True
    now: object = None
    on_duplicate: str = "error"
    buckets: int = 256
    staged: bool = True


@dataclass(frozen=True)
class Events:
    """An events table and its registry; ``announced`` has the registry's source_number, endpoint and priority."""

    table: str
    registry: str
    evid: int
    announced: Mapping[str, object]
    build: Callable[[DataFrame], DataFrame] | None = None
    seen: DataFrame | None = None
    where: Column | None = None
    limit: int | None = None


def store_results(df: DataFrame, key: str | Sequence[str], run_type: str | None = None, execution_date=None,
                  *, history: History | None = None, wide: Wide | None = None, events: Events | None = None,
                  store: bool = True, stored: bool = False, run: str | None = None) -> None:
    """Put a result into the places that are given, one after another, or nowhere with ``store=False``.

    A result for several places is first written to the shared folder, so that it is computed once and all
    places get the same rows; ``stored`` says that it is a table already. With the name of a ``run`` each place takes
    the result once for that run, so a run that broke off can be tried again as a whole.
    """
    if not store:
        return
    spark = df.sparkSession
    with ExitStack() as temporary:
        if not stored and sum(place is not None for place in (history, wide, events)) > 1:
            df = stage(df, temporary.enter_context(scratch(spark, "result")), "result")
            stored = True
        if history:
            append_to_history(df, history.table, run_type, execution_date, columns=history.columns,
                              nulls=history.nulls, sort_by=history.sort_by, replace_run=history.replace_run, run=run)
        if wide:
            merge_into_wide(spark, wide.table, df, key, wide.date_columns, select_fields=wide.select_fields,
                            date_updated=wide.date_updated, now=wide.now, on_duplicate=wide.on_duplicate,
                            buckets=wide.buckets, stored=stored, staged=wide.staged, run=run)
        if events:
            source = events.build(df) if events.build else df
            rows = events_to_write(source, key, events.seen, events.where, events.limit)
            write_events(rows, events.table, events.registry, events.evid, run=run, **events.announced)
