"""Small files of the catalog and commit logs, in any store that Hadoop reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._Path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        p = self._Path(self.path(folder))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def size(self, name: str) -> int:
        """Bytes of a file or of all files in a folder."""
        return int(self._fs.getContentSummary(self._Path(self.path(name))).getLength())

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._Path(self.path(name))))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._Path(self.path(name)))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def _write(self, stream, text: str) -> None:
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if it is there already."""
        p = self._Path(self.path(name))
        self._fs.mkdirs(p.getParent())
        try:
            stream = self._fs.create(p, False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        self._write(stream, text)
        return True

    def replace(self, name: str, text: str) -> None:
        """Writes a file over an older one: a reader sees one or the other, or for a moment none."""
        new = self._Path(self.path(f"{name}.{uuid.uuid4().hex}.new"))
        p = self._Path(self.path(name))
        self._fs.mkdirs(p.getParent())
        self._write(self._fs.create(new, True), text)
        if not self._fs.rename(new, p):
            self._fs.delete(p, False)
            self._fs.rename(new, p)

    def delete(self, name: str) -> None:
        self._fs.delete(self._Path(self.path(name)), True)
