"""File operations through Hadoop's file systems, so that a store may lie anywhere Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts]) if parts else self.root

    def path(self, where: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{where}" if where else self.root)

    def exists(self, where: str) -> bool:
        return self.fs.exists(self.path(where))

    def mkdirs(self, where: str) -> None:
        self.fs.mkdirs(self.path(where))

    def names(self, where: str) -> list[tuple[str, bool, int]]:
        """(name, is a folder, size) of what a folder holds, by name."""
        if not self.exists(where):
            return []
        return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in self.fs.listStatus(self.path(where)))

    def read(self, where: str) -> bytes:
        stream = self.fs.open(self.path(where))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, where: str, data: bytes) -> None:
        """Write beside the target, then put it in its place; ``settle`` finishes what a crash cut short."""
        aside = self.path(where + ".next")
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        self.fs.delete(self.path(where), False)
        self.fs.rename(aside, self.path(where))

    def settle(self, where: str) -> None:
        """The target is only deleted once what follows it is whole: without a target, that takes its place."""
        aside = where + ".next"
        if self.exists(aside) and not self.exists(where):
            self.fs.rename(self.path(aside), self.path(where))

    def delete(self, where: str) -> None:
        self.fs.delete(self.path(where), True)

    def size(self, where: str) -> int:
        """Bytes of all regular files below."""
        return self.fs.getContentSummary(self.path(where)).getLength() if self.exists(where) else 0
