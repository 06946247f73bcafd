"""Small files and folders in any store that Hadoop reaches: what commits need."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


class Folder:
    """A path, and the file operations under it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        where = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """Sorted names of what the folder holds; none if it doesn't exist."""
        if not self.exists(name):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(name)))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, *blocks: bytes) -> bool:
        """Write a new file; False if it exists already, whoever made it."""
        return self.create_from(name, blocks)

    def create_from(self, name: str, blocks: Iterable[bytes]) -> bool:
        """create() of blocks as they come; no more than one is held. If they raise, no file stays."""
        try:
            stream = self._fs.create(self._at(name), False)
        except Exception as e:
            if self.exists(name):
                return False
            raise OSError(f"{name} can't be written") from e
        try:
            for block in blocks:
                stream.write(bytearray(block))
        except BaseException:
            stream.close()
            self.delete(name)
            raise
        stream.close()
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def move(self, name: str, to: str) -> bool:
        """Rename within the folder; False if there is no source, or the target exists."""
        if not self.exists(name) or self.exists(to):
            return False
        return self._fs.rename(self._at(name), self._at(to))
