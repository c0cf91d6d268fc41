"""Small files and folders on any file system that Spark can write to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder by its path or URI; a path without a scheme is one of the mounted file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self.uri = path if ":" in path.split("/")[0] else f"file://{path}"
        root = self._path("")
        self._files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(root)
        #: The folder as the driver's own file system has it, or None.
        self.local = root.toUri().getPath() if self.uri.startswith("file:") else None

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.uri.rstrip('/')}/{name}".rstrip("/"))

    def at(self, name: str) -> str:
        return f"{self.uri.rstrip('/')}/{name}"

    def make(self, name: str) -> None:
        self._files.mkdirs(self._path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._files.listStatus(self._path(name))]

    def size(self, name: str) -> int:
        """Bytes in all files below."""
        return self._files.getContentSummary(self._path(name)).getLength()

    def read(self, name: str) -> str:
        stream = self._files.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._files.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a new file that appears whole or not at all: beside its place, then renamed. An error if it is there.

        This needs a file system whose rename is atomic; override it for stores that have a conditional put instead.
        """
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        self.write(draft, text)
        if self._files.exists(self._path(name)) or not self._files.rename(self._path(draft), self._path(name)):
            self.remove(draft)
            raise FileExistsError(f"another writer published {name}")

    def remove(self, name: str) -> None:
        self._files.delete(self._path(name), True)
