"""Numbered pointers: small texts that are made whole before they get their name.

A reader takes the largest number; of two writers of one number the second
fails. Nothing is replaced, so a reader sees the old state or the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Pointers:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The largest number, or -1."""
        p = self._path(f"{self.root}/pointers")
        names = [f.getPath().getName() for f in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def read(self, number: int) -> str:
        stream = self._fs.open(self._path(f"{self.root}/pointers/{number:012d}"))
        try:
            return bytes(self._io.toByteArray(stream)).decode()
        finally:
            stream.close()

    def commit(self, number: int, text: str) -> None:
        """Make ``text`` the pointer of this number, which must be free."""
        made = self._path(f"{self.root}/made/{uuid.uuid4().hex}")
        out = self._fs.create(made)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(f"{self.root}/pointers/{number:012d}")
        self._fs.mkdirs(target.getParent())
        # a rename takes no name that is taken, but the local file system's does
        if self._fs.exists(target) or not self._fs.rename(made, target):
            raise RuntimeError("another writer has committed")
