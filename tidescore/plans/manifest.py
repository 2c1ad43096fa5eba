"""What a run has finished: files inside its schema's folder, each created once its part is complete."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import fields, is_dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Row, SparkSession

from tidescore.sources.files import Files
from tidescore.sources.scratch import stage
from tidescore.sources.tables import table_exists


class ChangedStepError(ValueError):
    """A part of the run is finished, but its inputs or parameters are not those of this call."""


def fingerprint(*values) -> str:
    """A digest of settings. Functions count by their name, frames by their columns, expressions by their text."""
    return sha256(json.dumps([_plain(value) for value in values]).encode()).hexdigest()


def _plain(value):
    if isinstance(value, DataFrame):
        return ["frame", value.schema.jsonValue()]
    if isinstance(value, Column):
        return ["column", str(value)]
    if is_dataclass(value):
        return [type(value).__name__, *[[field.name, _plain(getattr(value, field.name))] for field in fields(value)]]
    if isinstance(value, Mapping):
        return {str(name): _plain(one) for name, one in sorted(value.items())}
    if callable(value):
        return [getattr(value, "__module__", ""), getattr(value, "__qualname__", type(value).__name__)]
    if isinstance(value, Sequence) and not isinstance(value, str):
        return [_plain(one) for one in value]
    return str(value)


class Manifest:
    """The finished parts of a run. One that is not ``kept`` does every part and writes nothing down."""

    def __init__(self, spark: SparkSession, schema: str, kept: bool):
        self.spark, self.schema, self.kept = spark, schema, kept
        if kept:
            found = spark.sql(f"DESCRIBE SCHEMA {schema}").filter("info_name = 'Location'").first()
            self.location = found["info_value"].rstrip("/")
            self.files = Files(spark, self.location)

    def token(self, part: str) -> str | None:
        """The name under which places outside the run take the result of a part once."""
        return f"{self.location} {part}" if self.kept else None

    def finished(self, part: str, settings: str) -> dict | None:
        path = f"{self.location}/_manifest/{part}"
        if not self.files.exists(path):
            return None
        found = json.loads(self.files.read(path))
        if found["settings"] != settings:
            raise ChangedStepError(f"{part} of {self.schema} was finished with other inputs or parameters")
        return found["says"]

    def once(self, part: str, settings: str, work: Callable[[], object]):
        """Do a part unless it is finished; what it returned then or returns now, as JSON keeps it."""
        if not self.kept:
            return work()
        found = self.finished(part, settings)
        if found is None:
            found = {"result": work()}
            self.files.create_if_absent(f"{self.location}/_manifest/{part}", json.dumps({"settings": settings, "says": found}))
        return found["result"]

    def stage(self, part: str, settings: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Write a table of the run unless it is finished, and read it."""
        table = f"{self.schema}.{part}"
        self.once(part, settings, lambda: self._write(build(), part))
        if not table_exists(self.spark, table):  # a catalog that lasts as long as a session has forgotten it
            self.spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{self.location}/{part}'")
        return self.spark.table(table)

    def _write(self, df: DataFrame, part: str) -> None:
        stage(df, self.schema, part)

    def row(self, part: str, settings: str, work: Callable[[], Row]) -> Row:
        """A row of numbers that a part has counted."""
        return Row(**self.once(part, settings, lambda: work().asDict()))
