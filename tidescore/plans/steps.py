"""A chain of scoring steps: build, score, check, join, audit, store."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidescore.operators.audit import dropped_rows, funnel_audit, require_coverage
from tidescore.operators.history import append_to_history
from tidescore.operators.lookup import join_result
from tidescore.operators.scoring import score, score_with_columns
from tidescore.plans.store import Events, History, Wide, store_results
from tidescore.plans.manifest import Manifest, fingerprint
from tidescore.sources.scratch import drop_schema, named_schema, scratch_schema
from tidescore.sources.tables import ensure_table, load


@dataclass(frozen=True)
class Model:
    """A model, the features it reads, and the coverage it has to reach.

    It is given in one of three forms: ``load`` with the columns it adds as DDL in ``predictions``, as for
    ``score``; ``columns``, new columns as expressions; or ``table``, where its predictions are already stored
    under the chain's key.
    """

    name: str
    features: Sequence[str]
    load: Callable | None = None
    predictions: str = ""
    threshold: float = 99.0
    columns: Mapping[str, Column] | None = None
    table: str | None = None

    def __post_init__(self):
        if sum(form is not None for form in (self.load, self.columns, self.table)) != 1:
            raise ValueError(f"model {self.name}: give one of load, columns and table")


@dataclass(frozen=True)
class Step:
    """One step of a chain.

    ``build`` makes the step's table from its input: a function of the input frame, or SQL text that reads
    ``{input}``; ``params`` are the function's arguments or the text's named parameters. Without ``build``
    the input is taken as it is, and not copied if it is a stored table. The input is the previous step's output unless ``input_step`` names
    another one or ``input_table`` a table.
    """

    name: str
    build: Callable[..., DataFrame] | str | None = None
    params: Mapping = field(default_factory=dict)
    input_step: str | None = None
    input_table: str | None = None
    model: Model | None = None
    history: History | None = None
    wide: Wide | None = None
    events: Events | None = None


def sql_frame(df: DataFrame, sql: str, params: Mapping | None = None) -> DataFrame:
    """Run SQL text that reads ``{input}``, with named parameters; a missing one raises ValueError."""
    if not sql or not sql.strip():
        raise ValueError("no SQL given")
    try:
        return df.sparkSession.sql(sql, args=dict(params or {}), input=df)
    except AnalysisException as error:
        if error.getCondition() == "UNBOUND_SQL_PARAMETER":
            raise ValueError(f"a parameter of the SQL has no value: {error}") from error
        raise


def sql_step(name: str, templates: Mapping[str, str], index: str, **params) -> Step:
    """A step from a collection of named SQL texts; an unknown or empty one raises ValueError."""
    if not templates.get(index):
        raise ValueError(f"no SQL found for {index!r}")
    return Step(name, templates[index], params)


@dataclass
class ChainResult:
    """The stored outputs by step, the coverage row of every scored step, and the dropped rows."""

    spark: SparkSession
    schema: str
    outputs: dict[str, DataFrame]
    coverage: dict[str, Row]
    dropped: DataFrame

    def drop_temps(self) -> None:
        """Drop the run's own tables; history, wide and events tables stay."""
        drop_schema(self.spark, self.schema)


def run_chain(spark: SparkSession, source: DataFrame | str, steps: Sequence[Step], key: str, *,
              run_type: str = "daily", execution_date=None, only: Sequence[str] | None = None,
              overrides: Mapping[str, Mapping] | None = None, dropped_history: str | None = None,
              store: bool = True, resume: str | None = None) -> ChainResult:
    """Run the steps in order and record what each of them dropped.

    Every step's output is written once as a table of the run and read from there by the next step, the
    audit and the sinks. A scored step is checked for coverage before it is joined; keys without a
    prediction are recorded as ``model_<model name>`` with priority 1. Keys of one output that the next
    lacks are recorded under the next step's name with priority 2; a key can be in both records.

    ``only`` runs just the steps it names, and ``overrides`` changes fields of single steps, for backfills.
    ``dropped_history`` names the history table that the run's dropped rows are appended to. A run that fails
    leaves none of its own tables behind.

    ``resume`` gives the run a name, which is that of its schema. Such a run keeps its tables when it fails, with a manifest of
    what is finished, and the same call again goes on after the last finished part: no step is built or scored twice,
    and history, wide table, events and dropped history take each result once, wherever the run broke off. A
    finished part whose inputs or parameters have changed since raises ``ChangedStepError``.
    """
    steps = _selected(steps, only, overrides or {})
    schema = scratch_schema(spark, "run") if resume is None else named_schema(spark, resume)
    manifest = Manifest(spark, schema, kept=resume is not None)
    try:
        return _run(spark, manifest, source, steps, key, run_type, execution_date, dropped_history, store)
    except BaseException:
        if resume is None:
            drop_schema(spark, schema)
        raise


def _run(spark: SparkSession, manifest: Manifest, source: DataFrame | str, steps: Sequence[Step], key: str, run_type: str,
         execution_date, dropped_history: str | None, store: bool) -> ChainResult:
    is_stored = isinstance(source, str)
    current = load(spark, source) if is_stored else source
    key_type = current.schema[key].dataType.simpleString()
    # What the parts of a run depend on: the run itself, and for each step its own settings and those before it.
    before = fingerprint(source, key, run_type, execution_date)

    outputs: dict[str, DataFrame] = {}
    tables: dict[str, str | None] = {}  # where an output is stored
    current_at = source if is_stored else None
    rows: dict[str, Row] = {}
    dropped: list[DataFrame] = []
    for step in steps:
        is_stored = is_stored or bool(outputs) or bool(step.input_table or step.input_step)
        before = fingerprint(before, step)
        kernel = _input(spark, step, outputs, current)
        kernel_at = step.input_table or (tables[step.input_step] if step.input_step else current_at)
        if step.build is not None or not is_stored:
            name = step.name if step.model is None else f"{step.name}__kernel"
            kernel = manifest.stage(name, before, lambda: _build(kernel, step))
            kernel_at = f"{manifest.schema}.{name}"
        if step.model is None:
            current, current_at = kernel, kernel_at
        else:
            scored, scored_at = _predictions(spark, manifest, step, kernel, key, before)
            rows[step.name] = manifest.row(f"{step.name}__coverage", before, lambda: require_coverage(
                kernel_at or kernel, scored_at or scored, step.model.threshold, step.model.name, spark))
            dropped.append(dropped_rows(kernel, scored, key, f"model_{step.model.name}", 1.0, "except"))
            current = manifest.stage(step.name, before, lambda: join_result(kernel, scored, key, step.model.features))
            current_at = f"{manifest.schema}.{step.name}"
        outputs[step.name], tables[step.name] = current, current_at
        manifest.once(f"{step.name}__stored", before, lambda: store_results(
            current, key, run_type, execution_date, history=step.history, wide=step.wide, events=step.events,
            store=store, stored=True, run=manifest.token(step.name)))
    if len(outputs) > 1:
        dropped.append(funnel_audit(list(outputs.items()), key))
    table = _dropped_table(spark, manifest, dropped, key, key_type, before)
    if dropped_history:
        manifest.once("dropped_history", before, lambda: append_to_history(
            table, dropped_history, run_type, execution_date, run=manifest.token("dropped_history")))
    return ChainResult(spark, manifest.schema, outputs, rows, table)


def _dropped_table(spark: SparkSession, manifest: Manifest, dropped: Sequence[DataFrame], key: str, key_type: str,
                   before: str) -> DataFrame:
    """All records of dropped rows, written once at the end."""
    if not dropped:
        return ensure_table(spark, f"{manifest.schema}.dropped_rows", f"`{key}` {key_type}, drop_step string, priority double")
    typed = [frame.select(F.col(f"`{key}`").cast(key_type).alias(key), "drop_step", "priority") for frame in dropped]
    return manifest.stage("dropped_rows", before, lambda: reduce(DataFrame.unionAll, typed))


def _predictions(spark: SparkSession, manifest: Manifest, step: Step, kernel: DataFrame, key: str,
                 before: str) -> tuple[DataFrame, str | None]:
    """The model's predictions and their table: stored ones as they are, expressions unstored, those of a function stored once."""
    model = step.model
    if model.table is not None:
        return load(spark, model.table), model.table
    if model.columns is not None:
        return score_with_columns(kernel, key, model.features, model.columns), None
    part = f"{step.name}__scored"
    scored = manifest.stage(part, before, lambda: score(kernel, key, model.features, model.load, model.predictions))
    return scored, f"{manifest.schema}.{part}"


def _selected(steps: Sequence[Step], only: Sequence[str] | None, overrides: Mapping[str, Mapping]) -> list[Step]:
    names = [step.name for step in steps]
    unknown = [name for name in [*(only or []), *overrides] if name not in names]
    if unknown or len(set(names)) < len(names):
        raise ValueError(f"unknown or repeated step names: {unknown or names}")
    chosen = [step for step in steps if only is None or step.name in only]
    return [replace(step, **overrides.get(step.name, {})) for step in chosen]


def _input(spark: SparkSession, step: Step, outputs: Mapping[str, DataFrame], current: DataFrame) -> DataFrame:
    if step.input_table:
        return load(spark, step.input_table)
    if step.input_step:
        if step.input_step not in outputs:
            raise ValueError(f"{step.name} reads the output of {step.input_step}, which has not run")
        return outputs[step.input_step]
    return current


def _build(df: DataFrame, step: Step) -> DataFrame:
    if step.build is None:
        return df
    if isinstance(step.build, str):
        return sql_frame(df, step.build, step.params)
    return df.transform(step.build, **step.params)
