"""Small files on any file system that Spark reaches, through Hadoop's FileSystem; never through local paths."""

from __future__ import annotations

import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def uri(place: str | Path) -> str:
    """A local path as file:///...; anything with a scheme as it is."""
    text = str(place)
    return text.rstrip("/") if "://" in text or text.startswith("file:") else Path(text).absolute().as_uri()


class Folder:
    """A folder of a file system."""

    def __init__(self, spark: SparkSession, place: str | Path):
        self.spark, self.uri = spark, uri(place)
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """What the folder holds, sorted; nothing if it isn't there."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Write a whole file under a name that nobody has taken; False if somebody has.

        The file is written aside and renamed without overwriting, which HDFS does in one step. The local file system
        looks first and renames then, so there two writers of the same moment aren't told apart.
        """
        aside = self._path(f".{name.rpartition('/')[2]}-{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        gateway = self.spark.sparkContext._gateway
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.NONE
        self._fs.mkdirs(self._path(name).getParent())
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, self._path(name), options)
            return True
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def files(self, name: str) -> list[tuple[str, int, int]]:
        """(path below this folder, bytes, time) of every file under a folder, sorted; a file's own folder holds it. Marker files are left out."""
        found, out = self._fs.listFiles(self._path(name), True), []
        top = self._path("").toUri().getPath()
        while found.hasNext():
            s = found.next()
            path = s.getPath().toUri().getPath()[len(top) + 1 :]
            if not path.rpartition("/")[2].startswith(("_", ".")):
                out.append((path, s.getLen(), s.getModificationTime()))
        return sorted(out)
