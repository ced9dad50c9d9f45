"""Results that outlive the session: versions of a table in a folder, and a pointer to the one that holds.

A version is written whole under a new name, and then committed by creating the next numbered pointer file, which
the file system does for one writer only. Readers take the highest pointer: they see a whole version or the one
before, never a part. No version that a pointer names is ever changed.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed first, and the caller asked not to follow it."""


class Snapshots:
    """Named results under one root, any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """The committed versions' numbers, in order."""
        folder = self._path(f"{self.root}/{name}/_commits")
        if not self.files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(folder)]  # a file a version
        return sorted(int(n) for n in names if n.isdigit())

    def _where(self, name: str, version: int) -> str:
        stream = self.files.open(self._path(f"{self.root}/{name}/_commits/{version}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, pointer: str, place: str) -> None:
        """Creates a pointer, or fails if there is one."""
        path, text = self._path(pointer), bytearray(place.encode())
        if self.files.getScheme() == "file":  # whose Hadoop client looks first and creates then
            jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
            own = jvm.java.nio.file.Path.of(path.toUri().getPath(), gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createDirectories(own.getParent(), gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            options = gateway.new_array(jvm.java.nio.file.OpenOption, 2)
            options[0], options[1] = jvm.java.nio.file.StandardOpenOption.CREATE_NEW, jvm.java.nio.file.StandardOpenOption.WRITE
            jvm.java.nio.file.Files.write(own, bytes(text), options)
            return
        stream = self.files.create(path, False)
        stream.write(text)
        stream.close()

    def publish(self, df: DataFrame, name: str, after: int | None = None, tries: int = 100) -> int:
        """Writes df as the next version of name and returns its number.

        With `after`, only if that is still the last version (0: if there is none); else Conflict is raised.
        """
        place = f"{self.root}/{name}/data-{uuid.uuid4().hex}"
        df.write.parquet(place)
        for _ in range(tries):
            last = max(self.versions(name), default=0)
            if after is not None and last != after:
                raise Conflict(f"{name} is at version {last}, not {after}")
            try:
                self._commit(f"{self.root}/{name}/_commits/{last + 1}", place)
            except Py4JJavaError:  # another writer was faster
                continue
            return last + 1
        raise Conflict(f"{name}: {tries} other versions were committed meanwhile")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A version, by default the last."""
        known = self.versions(name)
        while known and version is None:
            where = self._where(name, known[-1])
            if where:
                return self.spark.read.parquet(where)
            known.pop()  # a pointer whose writer has not filled it yet
        if version not in known:
            raise KeyError(f"{name} has no version {version or ''}".rstrip())
        return self.spark.read.parquet(self._where(name, version))

    def forget(self, name: str, keep: int = 1) -> None:
        """Deletes all but the last `keep` versions."""
        for v in self.versions(name)[: -keep or None]:
            where = self._where(name, v)
            self.files.delete(self._path(f"{self.root}/{name}/_commits/{v}"), False)
            self.files.delete(self._path(where), True)
