"""Folders of any Hadoop file system: small files, and tables that cut lineage."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """Files below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._fs.getUri().getScheme() == "file":  # without checksum files, so that others may write here too
            self._fs = self._fs.getRawFileSystem()

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *(p for p in parts if p)]))

    def children(self, *parts: str) -> list[str]:
        if not self._fs.exists(self._at(*parts)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(*parts)))

    def has(self, *parts: str) -> bool:
        return self._fs.exists(self._at(*parts))

    def remove(self, *parts: str) -> None:
        self._fs.delete(self._at(*parts), True)

    def read(self, *parts: str) -> str:
        stream = self._fs.open(self._at(*parts))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, content: str, *parts: str, replace: bool = False) -> None:
        """A whole file or none: it is written aside, then renamed. Without ``replace``, a file that is there already is an error."""
        aside = self._at(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(content.encode()))
            stream.hsync()
        finally:
            stream.close()
        how = self._hadoop.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(how, 1)
        options[0] = how.OVERWRITE if replace else how.NONE
        try:
            self._hadoop.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._at(*parts)), options)
        except Exception as e:
            self._fs.delete(aside, False)
            raise FileExistsError(f"{self._at(*parts).toString()} can't be written") from e


class JsonFile:
    """A small JSON file (SRC23, SNK09): the default where it is missing or blank; saved whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        folder, _, self.name = path.rpartition("/")
        self.folder = Folder(spark, folder)

    def load(self, default: Any = None) -> Any:
        content = self.folder.read(self.name) if self.folder.has(self.name) else ""
        return json.loads(content) if content.strip() else default

    def save(self, value: Any) -> None:
        self.folder.write(json.dumps(value, ensure_ascii=False, indent=2), self.name, replace=True)


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A new folder that all executors share, below ``spark.checkpoint.dir``; it goes when the Python process ends.

    Where the setting is missing, a local master gets a folder of its own, which is written back to the setting; a cluster without it is an error,
    since its executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="fathomline-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/fathomline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        Folder(spark, path).remove()
    except Exception:  # the session has ended
        return


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes ``df`` to a folder of :func:`scratch` and reads it back: later stages survive lost executors, and plans stay short."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join whose both sides grow with the input: they meet by a shuffle, and nothing goes through the driver.

    Spark knows a written or kept table by its packed bytes. Keys and names pack well, so a million rows look small enough to broadcast, and
    then take hundreds of megabytes in the driver.
    """
    return df.hint("merge")
