"""Files in the folders of tables, on whatever file system the session's paths name."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """The file system of one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self._path(path).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), conf)
        self.is_local = self.system.getUri().getScheme() == "file"

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.system.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """What a folder holds, sorted; a folder that is not there holds nothing."""
        try:
            found = self.system.listStatus(self._path(path))
        except Py4JJavaError as error:
            if "FileNotFoundException" in str(error.java_exception.getClass()):
                return []
            raise
        return sorted(status.getPath().getName() for status in found)

    def read(self, path: str) -> str:
        stream = self.system.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def move(self, path: str, new: str) -> bool:
        """Move a file; False if it is not there, because somebody else has moved it."""
        source, target = self._path(path), self._path(new)
        if not self.system.exists(source):
            return False
        self.system.mkdirs(target.getParent())
        try:
            if self.system.rename(source, target):
                return True
        except Py4JJavaError:
            if self.system.exists(source):
                raise
        if self.system.exists(source):
            raise OSError(f"{path} could not be moved to {new}")
        return False

    def delete(self, path: str) -> None:
        """Remove a file or a folder with all that is in it, if it is there."""
        self.system.delete(self._path(path), True)

    def create_if_absent(self, path: str, text: str) -> bool:
        """Write a file that is not there yet; False if it is. Of several writers, in any process, one succeeds.

        The text is first written under another name. What then decides is one operation of the file system: a link on
        local disks, and elsewhere a rename that refuses to replace, which HDFS does at once. Object stores whose
        renames are copies do not promise this.
        """
        folder, _, name = path.rpartition("/")
        draft = f"{folder}/.{name}.{uuid4().hex[:12]}"
        self.system.mkdirs(self._path(folder))
        if self.is_local:
            target, draft = (unquote(urlparse(one).path) if one.startswith("file:") else one for one in (path, draft))
            with open(draft, "w", encoding="utf-8") as file:
                file.write(text)
                file.flush()
                os.fsync(file.fileno())
            try:
                os.link(draft, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        stream = self.system.create(self._path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        try:
            self.context.rename(self._path(draft), self._path(path), options)
            return True
        except Py4JJavaError as error:
            self.delete(draft)
            if "FileAlreadyExistsException" in str(error.java_exception.getClass()):
                return False
            raise


def file_of(address: str) -> str:
    """The path of a file whose address Spark gives with escapes."""
    return unquote(address)
