"""Small driver-side files through Hadoop's file systems, so that stores live on any path Spark can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> None:
        """A new file; fails if it exists, which makes it a lock."""
        fs, p = self._at(path)
        stream = fs.create(p, False)
        stream.write(data)
        stream.close()

    def publish(self, path: str, data: bytes) -> None:
        """Write beside, then rename over: readers see the old or the new file, never half of one."""
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        self.create(beside, data)
        fs, p = self._at(path)
        if fs.exists(p):
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.conf)
            options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
            options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
            context.rename(self.jvm.org.apache.hadoop.fs.Path(beside), p, options)
        elif not fs.rename(self.jvm.org.apache.hadoop.fs.Path(beside), p):
            raise OSError(f"can't publish {path}")
