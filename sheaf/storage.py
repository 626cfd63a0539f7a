"""Files below a folder that all executors share: written tables, small JSON files, renames."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


#: Codec of written tables.
COMPRESSION = "zstd"


class CatalogError(RuntimeError):
    """The stored state does not allow the operation."""


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; only local sessions without it get their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise CatalogError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sheaf-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Written as Parquet and read back, which ends its lineage."""
    path = path or shared_folder(df.sparkSession)
    df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """The few file operations that snapshots need, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def folders(self) -> dict[str, float]:
        """Folders right below the root and the seconds since each was changed."""
        now = time.time()
        return {f.getPath().getName(): now - f.getModificationTime() / 1000 for f in self.fs.listStatus(self._path("")) if f.isDirectory()}

    def names(self, folder: str) -> list[str]:
        """What lies right below a folder, by name; nothing where there is none."""
        if not self.exists(folder):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._path(folder)))

    def age(self, name: str) -> float:
        """Seconds since it was changed."""
        return time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def stamp(self, name: str) -> str:
        """What tells a table's files from others in their place: names, lengths and times."""
        return ";".join(sorted(f"{f.getPath().getName()},{f.getLen()},{f.getModificationTime()}" for f in self.fs.listStatus(self._path(name))))

    def size(self, name: str) -> int:
        """Bytes of all files below it."""
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def read_json(self, name: str) -> dict[str, Any] | None:
        """A JSON object, or null where there is no file; anything else is refused."""
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            value = json.loads(text)
        except ValueError as error:
            raise CatalogError(f"{name} is no JSON") from error
        if not isinstance(value, dict):
            raise CatalogError(f"{name} must hold a JSON object")
        return value

    def write_json(self, name: str, value: dict[str, Any]) -> None:
        """Written aside, then renamed over the old file."""
        self._rename(self._aside(name, value), name, "OVERWRITE")

    def create_json(self, name: str, value: dict[str, Any]) -> bool:
        """Write a file that nobody else has written; false, and no change, where there is one.

        Of several writers at once one succeeds: a rename that does not overwrite is one step on
        file systems of clusters, and a hard link is on a local one.
        """
        aside = self._aside(name, value)
        try:
            if self.fs.getUri().getScheme() == "file":
                place = lambda x: self.jvm.java.io.File(self._path(x).toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(place(name), place(aside))
            else:
                self._rename(aside, name, "NONE")
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.fs.delete(self._path(aside), False)
        return True

    def _aside(self, name: str, value: dict[str, Any]) -> str:
        folder, _, last = name.rpartition("/")
        aside = f"{folder}/.{last}.{uuid.uuid4().hex}" if folder else f".{last}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(aside), True)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()))
        finally:
            stream.close()
        return aside

    def _rename(self, old: str, new: str, option: str) -> None:
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        context.rename(self._path(old), self._path(new), spark_array(self.jvm, kinds, [getattr(kinds, option)]))


def spark_array(jvm, kind, values):
    """A Java array of the enum type with the given values."""
    from pyspark import SparkContext

    array = SparkContext._gateway.new_array(kind, len(values))
    for i, v in enumerate(values):
        array[i] = v
    return array
