"""Tables whose rows are replaced whole or not at all.

A table is a folder with ``versions/<number>-<id>``, the rows of each version, and ``current/<number>``, a marker written once
the rows of that version are complete. Readers take the version of the highest marker. A write that fails leaves rows without a
marker, which nobody reads; a table can be read while it is replaced, by the query that replaces it, too. Markers are never
overwritten, so that nothing depends on renaming, and of two writers that replace the same version one fails.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .tables import conform

KEPT = 2  # complete versions that stay


class Conflict(RuntimeError):
    """Another writer has replaced the table meanwhile."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *[p for p in parts if p]]))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _folder(self, number: str) -> str:
        stream = self._fs.open(self._path("current", number))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def version(self) -> int:
        """The number of the current version, 0 if there is none."""
        return max((int(n) for n in self._names("current") if n.isdigit()), default=0)

    def location(self) -> str:
        """Where the current rows lie."""
        number = self.version()
        if not number:
            raise FileNotFoundError(f"no table at {self.path}")
        return f"{self.path}/versions/{self._folder(f'{number:010d}')}"

    def read(self) -> DataFrame:
        """The current rows; a frame keeps reading the version that it was made from."""
        return self.spark.read.parquet(self.location())

    def replace(self, df: DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
        """Write new rows, cast to a declared schema if one is given, then make them the current ones.

        ``df`` may read this table. An error on the way leaves the old rows.
        """
        before = self.version()
        folder = f"{before + 1:010d}-{uuid.uuid4().hex}"
        (conform(df, schema) if schema else df).write.parquet(f"{self.path}/versions/{folder}")
        self._mark(f"{before + 1:010d}", folder)
        self._clean()
        return self.read()

    def _mark(self, number: str, folder: str) -> None:
        try:
            stream = self._fs.create(self._path("current", number), False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()) or "already exists" in str(error.java_exception):
                raise Conflict(f"{self.path}: version {int(number)} has been written meanwhile") from None
            raise
        try:
            stream.write(bytearray(folder.encode()))
        finally:
            stream.close()

    def _clean(self) -> None:
        """Remove markers and rows of versions before the last ``KEPT``; rows of a version still being written stay."""
        marked = self._names("current")
        kept = {self._folder(n) for n in marked[-KEPT:]}
        oldest = marked[-KEPT:][0]
        for n in marked[:-KEPT]:
            self._fs.delete(self._path("current", n), False)
        for folder in self._names("versions"):
            if folder not in kept and folder.split("-")[0] < oldest:
                self._fs.delete(self._path("versions", folder), True)


def replace_safely(df: DataFrame, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Replace the rows of a versioned table, creating it if needed."""
    return VersionedTable(df.sparkSession, path).replace(df, schema)
