"""Small files beside tables, through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import json

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import Unavailable


class Folder:
    """A small file is a row of numbered ones, <name>.<number>: the newest that is whole counts.

    A write creates the next number and nothing else, so a crash at any point
    leaves the state before it; two writers that read the same state can't both
    create it, and the second is refused.
    """

    def __init__(self, spark: SparkSession, root: str):
        self._read: dict[str, int] = {}
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _numbers(self, name: str) -> list[int]:
        folder, _, own = name.rpartition("/")
        return sorted((int(m[1]) for x in self.names(folder) if (m := re.fullmatch(re.escape(own) + r"\.(\d{12})", x))), reverse=True)

    def _load(self, name: str) -> dict | None:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        except ValueError:  # torn
            return None
        finally:
            stream.close()

    def exists(self, name: str = "") -> bool:
        """Of a folder, or of a small file in a folder that is there."""
        return self._fs.exists(self._path(self.at(name))) or bool(self._numbers(name))

    def read(self, name: str) -> dict:
        for n in self._numbers(name):
            value = self._load(f"{name}.{n:012d}")
            if value is not None:
                self._read[name] = n
                return value
        raise FileNotFoundError(self.at(name))

    def write(self, name: str, value: dict) -> None:
        """Whole or not at all; refused if another has written since this folder's last read of the name."""
        there = self._numbers(name)
        newest = next((n for n in there if self._load(f"{name}.{n:012d}") is not None), 0)
        if newest != self._read.get(name, newest):
            raise Unavailable(f"{self.at(name)} was changed by another writer")
        n = max(there, default=0) + 1
        try:
            stream = self._fs.create(self._path(self.at(f"{name}.{n:012d}")), False)
        except Py4JJavaError as e:
            raise Unavailable(f"{self.at(name)} was changed by another writer") from e
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        self._read[name] = n
        for old in there[1:]:  # the last one stays for readers under way
            self.delete(f"{name}.{old:012d}")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def names(self, name: str = "") -> list[str]:
        at = self._path(self.at(name))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []
