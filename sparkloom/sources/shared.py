"""Small files through Spark's file systems: documents of stores and registries, and the first bytes, size and digest of uploads.

A path without a scheme lies on the default file system, as Spark itself reads it, so every
process of a cluster finds what another one wrote.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from sparkloom.sources.scratch import qualified


class Files:
    """What a process needs of a file system, by path."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path):
        own = self.jvm.org.apache.hadoop.fs.Path(qualified(self.spark, str(path)))
        return own.getFileSystem(self.conf), own

    def exists(self, path) -> bool:
        fs, own = self._at(path)
        return fs.exists(own)

    def size(self, path) -> int:
        fs, own = self._at(path)
        return fs.getFileStatus(own).getLen()

    def read(self, path, most: int | None = None) -> bytes:
        """The whole file, or its first bytes."""
        fs, own = self._at(path)
        stream = fs.open(own)
        try:
            if most is not None:
                stream = self.jvm.org.apache.commons.io.input.BoundedInputStream.builder().setInputStream(stream).setMaxCount(most).get()
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def digest(self, path) -> str:
        """SHA-256, read as a stream."""
        fs, own = self._at(path)
        stream = fs.open(own)
        try:
            return self.jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def write(self, path, data: bytes) -> None:
        """Whole or not at all: written beside the path, then renamed onto it."""
        fs, own = self._at(path)
        part = self.jvm.org.apache.hadoop.fs.Path(own.getParent(), f".{own.getName()}.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self.conf).rename(part, own, how)

    def matching(self, pattern) -> list[str]:
        fs, own = self._at(pattern)
        return sorted(s.getPath().toString() for s in fs.globStatus(own) or [])

    def read_json(self, path):
        return json.loads(self.read(path).decode())
