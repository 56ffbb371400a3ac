"""Small files and folders next to a dataset, on any file system that Spark reads."""

from __future__ import annotations

import datetime as dt
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of small files, each written once and whole."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = self._hadoop(path)
        self._files = self._path.getFileSystem(self._conf)

    def _hadoop(self, path: str, name: str | None = None):
        kind = self._jvm.org.apache.hadoop.fs.Path
        return kind(path) if name is None else kind(path, name)

    def names(self, before: dt.datetime | None = None) -> list[str]:
        """Names of the files in the folder, or of those last changed before a moment; none if
        it is missing."""
        if not self._files.exists(self._path):
            return []
        found = self._files.listStatus(self._path)
        limit = None if before is None else before.timestamp() * 1000
        return sorted(f.getPath().getName() for f in found if limit is None or f.getModificationTime() < limit)

    def read(self, name: str) -> str:
        stream = self._files.open(self._hadoop(self._path, name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; False, and nothing written, if it does.

        The text goes to a file of another name, which then takes its name unless that is
        taken, in one step of the file system, as Spark's own stream logs do.
        """
        self._files.mkdirs(self._path)
        own, target = (self._hadoop(self._path, n) for n in (f".{uuid.uuid4().hex}.tmp", name))
        stream = self._files.create(own, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        kind = getattr(fs, "Options$Rename")
        keep = self._jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
        keep[0] = kind.NONE
        try:
            fs.FileContext.getFileContext(self._path.toUri(), self._conf).rename(own, target, keep)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            self._files.delete(own, False)
            return False

    def delete(self, name: str | None = None) -> None:
        """Remove a file or folder below this one, or this one."""
        self._files.delete(self._path if name is None else self._hadoop(self._path, name), True)
