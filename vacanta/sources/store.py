"""Files of a folder by size and range (S19, S20), over any file system that Hadoop reads."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.storage import hadoop_path
from .readers import safe_name


class RangeStore:
    """Parts of a folder's files. Where a file system refuses a range, the file is read whole
    once and ranges are cut from that."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.whole = spark, folder.rstrip("/"), {}

    def _open(self, name: str):
        path, fs = hadoop_path(self.spark, f"{self.folder}/{safe_name(name)}")
        return path, fs

    def size(self, name: str) -> int:
        path, fs = self._open(name)
        return fs.getFileStatus(path).getLen()

    def read(self, name: str, offset: int, length: int) -> bytes:
        """At most ``length`` bytes from ``offset`` on; fewer at the end of the file."""
        if offset < 0 or length < 0:
            raise ValueError("a range starts at 0 or later and has no negative length")
        if name in self.whole:
            return self.whole[name][offset : offset + length]
        length = max(0, min(length, self.size(name) - offset))
        if not length:
            return b""
        path, fs = self._open(name)
        stream = fs.open(path)
        try:
            stream.seek(offset)
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        except Exception:  # no ranges here
            self.whole[name] = self._all(name)
            return self.whole[name][offset : offset + length]
        finally:
            stream.close()

    def _all(self, name: str) -> bytes:
        path, fs = self._open(name)
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
