"""Changes of a table's files that take place once, whoever begins them and however often.

New rows are written in full to a folder inside the table's, whose name begins with an underscore so that no reader looks
into it. A record then names the new files, and the old ones that they replace; it is created only if there is none of
its name, and that decides which of several changes takes place, also between processes. Putting it in place moves
the new files and removes exactly the old ones that the record names, so it can be repeated, and by several processes at once,
without harm: a file that is already moved or removed is passed over. The rows are written only once, new
partitions are registered in one statement, and a change that broke off after its record is finished by whoever comes next.

While files move, a reader may see rows of both states; none are absent.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tidescore.sources.files import Files, file_of

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
DONE = ".done"
THREADS = 16


class LostChangeError(RuntimeError):
    """A recorded change cannot be put in place, because somebody removed its files."""


def table_folder(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").collect()
    return rows[-1]["data_type"].rstrip("/")  # a column may have that name too, but comes before


@dataclass
class Change:
    """New files below the folder ``staged``, old files that go, and what else the record says."""

    staged: str
    files: list[str]
    remove: list[str] = field(default_factory=list)
    says: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"staged": self.staged, "files": self.files, "remove": self.remove, "says": self.says})


class Log:
    """The records of one kind of change to one table."""

    def __init__(self, spark: SparkSession, name: str, kind: str):
        self.spark, self.table, self.folder = spark, name, table_folder(spark, name)
        self.files, self.records = Files(spark, self.folder), f"{self.folder}/_{kind}"

    def stage(self, df: DataFrame, partition_by: str | Sequence[str] = ()) -> Change:
        """Write rows next to the table's own; nothing of them is in the table yet."""
        staged = f"_staged_{uuid4().hex[:12]}"
        partitions = [partition_by] if isinstance(partition_by, str) else list(partition_by)
        writer = df.write.option("compression", "snappy")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{self.folder}/{staged}")
        addresses = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{staged}").inputFiles()
        return Change(staged, sorted(file_of(address).split(f"/{staged}/", 1)[1] for address in addresses))

    def listed(self, partitions: Iterable[str]) -> list[str]:
        """The files of some of the table's partition folders, or with "" of a table without partitions."""
        def files(partition):
            found = self.files.names(f"{self.folder}/{partition}".rstrip("/"))
            return [f"{partition}/{name}".lstrip("/") for name in found if name[0] not in "._"]

        with ThreadPoolExecutor(THREADS) as pool:
            return [path for found in pool.map(files, partitions) for path in found]

    def names(self) -> list[str]:
        return [name for name in self.files.names(self.records) if not name.endswith(DONE) and not name.startswith(".")]

    def says(self, record: str) -> dict:
        return json.loads(self.files.read(f"{self.records}/{record}"))["says"]

    def has(self, record: str) -> bool:
        return self.files.exists(f"{self.records}/{record}")

    def commit(self, record: str, change: Change) -> bool:
        """Decide for a change; False if there is a record of this name, and then the change's files go."""
        if self.files.create_if_absent(f"{self.records}/{record}", change.text()):
            return True
        self.drop(change)
        return False

    def drop(self, change: Change) -> None:
        self.files.delete(f"{self.folder}/{change.staged}")

    def finish(self, record: str) -> None:
        """Put a recorded change in place, unless that is done."""
        done = f"{self.records}/{record}{DONE}"
        if self.files.exists(done):
            return
        change = json.loads(self.files.read(f"{self.records}/{record}"))

        def move(path):
            new = f"{self.folder}/{path}"
            return self.files.move(f"{self.folder}/{change['staged']}/{path}", new) or self.files.exists(new)

        with ThreadPoolExecutor(THREADS) as pool:
            there = list(pool.map(move, change["files"]))
            # Who is late may look for files that another one has moved, and a later change has removed.
            if not all(there) and not self.files.exists(done):
                raise LostChangeError(f"{self.table}: files of the change {record} are gone")
            list(pool.map(lambda path: self.files.delete(f"{self.folder}/{path}"), change["remove"]))
        self.register(change["files"])
        self.files.create_if_absent(done, "")
        self.files.delete(f"{self.folder}/{change['staged']}")
        self.spark.catalog.refreshTable(self.table)

    def register(self, files: Iterable[str]) -> None:
        """Make the catalog know the partitions of some files, in one statement."""
        partitions = sorted({path.rpartition("/")[0] for path in files} - {""})
        if partitions:
            listed = " ".join(f"PARTITION ({_values(partition)})" for partition in partitions)
            self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS {listed}")


def _values(partition: str) -> str:
    """A partition folder as the SQL names it."""
    def value(text):
        if text == NULL_PARTITION:
            return "NULL"
        return "'" + unquote(text).replace("\\", "\\\\").replace("'", "\\'") + "'"

    pairs = (part.split("=", 1) for part in partition.split("/"))
    return ", ".join(f"`{unquote(name)}` = {value(text)}" for name, text in pairs)
