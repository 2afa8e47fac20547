"""Small files beside stored tables: manifests that say which folders count."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """The few file operations of a stored table, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._paths(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        if not self._fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file that is seen whole or not at all."""
        hidden = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(hidden, self._at(name)):
            raise OSError(f"{name} could not be put in place")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
