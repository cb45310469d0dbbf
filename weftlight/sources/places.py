"""Folders that driver and executors share, and what a store must do on them; all through the Hadoop file system."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir; only in local mode, and where it is unset, in a temporary folder of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="weftlight-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/weftlight/{what}-{uuid.uuid4().hex}"


class Folder:
    """Small files and subfolders of a path on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._at(name))) if self.fs.exists(self._at(name)) else []

    def ages(self, name: str) -> dict[str, float]:
        """Names in a folder, and when each was last changed, in seconds since 1970."""
        return {x.getPath().getName(): x.getModificationTime() / 1000 for x in self.fs.listStatus(self._at(name))} if self.fs.exists(self._at(name)) else {}

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def create(self, name: str, text: str) -> bool:
        """Write a file whole, unless one of that name is there: then False. Of two writers one gets True.

        The text goes to a file of its own, which then takes the name: by a hard link on a local disk, elsewhere by a rename
        that does not overwrite.
        """
        draft = f"{name.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}".lstrip("/")
        out = self.fs.create(self._at(draft), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        target = self._at(name).makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory())
        try:
            if target.toUri().getScheme() == "file":
                local = lambda n: urlparse(self._at(n).toUri().toString()).path or str(self._at(n))
                os.link(local(draft), local(name))
                return True
            rename = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename
            options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
            rename(self._at(draft), self._at(name), options)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.delete(draft)
