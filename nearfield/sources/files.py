"""Small files and folders by Hadoop's file systems, so that paths in any store work."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def read_json(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder; nothing where there is none."""
        path = self._path(name)
        return [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def state(self) -> str:
        """The names, sizes and times of the folder's files, or of the file."""
        found = self._fs.listStatus(self._path(""))
        return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))

    def write_new_json(self, name: str, value: object) -> bool:
        """Written beside its place first, so readers see all of it or nothing. False if the place is taken."""
        part = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(part), True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        try:
            context.rename(self._path(part), self._path(name), options)
        except Py4JJavaError as failed:
            self.delete(part)
            if "FileAlreadyExists" in failed.java_exception.getClass().getName():
                return False
            raise
        return True
