"""Small files on whatever store Spark can reach, through Hadoop's file system API."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.sc = spark.sparkContext
        self.jvm = self.sc._jvm
        self.conf = self.sc._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def list(self, folder: str) -> list[str]:
        where = self._path(folder)
        if not self.fs.exists(where):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def walk(self, folder: str) -> list[tuple[str, int, float]]:
        """(name below the root, bytes, seconds since it was written) of all files in a folder's subfolders."""
        where, out = self._path(folder), []
        if self.fs.exists(where):
            found = self.fs.listFiles(where, True)
            base = len(self.fs.makeQualified(self._path("")).toString()) + 1
            now = self.jvm.java.lang.System.currentTimeMillis()
            while found.hasNext():
                s = found.next()
                age = (now - s.getModificationTime()) / 1000
                out.append((s.getPath().toString()[base:], s.getLen(), age))
        return sorted(out)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_aside(self, name: str, text: str) -> str:
        """Writes text to a new file beside `name` that no reader looks at; its name."""
        folder, _, base = name.rpartition("/")
        aside = f"{folder}/.{base}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(aside), False)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        return aside

    def publish(self, aside: str, name: str) -> None:
        """Gives a finished file its name. FileExistsError if the name is taken: of several writers exactly one wins, however slow.

        On local disks a hard link decides, elsewhere a rename that doesn't overwrite.
        """
        here, there = self._path(aside), self._path(name)
        try:
            if self.fs.getUri().getScheme() == "file":
                paths = [self.jvm.java.io.File(p.toUri().getPath()).toPath() for p in (there, here)]
                self.jvm.java.nio.file.Files.createLink(*paths)
                self.fs.delete(here, False)
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(here.toUri(), self.conf)
                rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                context.rename(here, there, self.sc._gateway.new_array(rename, 0))
        except Py4JJavaError as e:
            self.fs.delete(here, False)
            if self.fs.exists(there):
                raise FileExistsError(name) from e
            raise

    def create(self, name: str, text: str) -> None:
        """A new file, whole from the moment it can be seen. FileExistsError if it is there."""
        self.publish(self.write_aside(name, text), name)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
