"""Numbered versions of a folder, committed by one atomic step of the file system: the base of every store here."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..functions.session import file_system


class Conflict(RuntimeError):
    """Another writer committed that version first; nothing of this commit can be seen."""


class Versions:
    """Version N is the file versions/N below a path, which names the folder that holds the version's files.

    A writer fills a folder of its own, then brings the whole file to its place in one step that fails where the file is
    there already: a hard link on a local disk, elsewhere a rename without overwriting, which HDFS does as one step. So of
    two writers of a version one gets `Conflict`, and a reader sees a version whole or not at all. What a lost writer
    leaves behind is named by no version. Object stores without such a rename need a file system layer that has one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        fs, to_path = file_system(self.spark, self.path)
        at = to_path(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> int:
        """The newest version; 0 where there is none."""
        return max([0, *self.numbers()])

    def folder(self, version: int) -> str | None:
        """The folder of a version; None where there is no such version."""
        fs, to_path = file_system(self.spark, self.path)
        at = to_path(f"{self.path}/versions/{version}")
        if not fs.exists(at):
            return None
        with_name = fs.open(at)
        try:
            raw = bytes(with_name.readAllBytes())
        finally:
            with_name.close()
        return f"{self.path}/{raw.decode()}"

    def new_folder(self, kind: str = "of") -> str:
        """A folder of this writer alone, not yet there."""
        return f"{self.path}/{kind}/{uuid.uuid4().hex}"

    def publish(self, folder: str, version: int) -> int:
        """Makes a folder that is filled the given version; raises `Conflict` if there is one."""
        fs, to_path = file_system(self.spark, self.path)
        jvm = self.spark.sparkContext._jvm
        fs.mkdirs(to_path(f"{self.path}/versions"))
        aside, at = to_path(f"{self.path}/versions/_{uuid.uuid4().hex}"), to_path(f"{self.path}/versions/{version}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(folder.removeprefix(f"{self.path}/").encode()))
        finally:
            out.close()
        try:
            uri = fs.makeQualified(at).toUri()
            if uri.getScheme() == "file":
                local = lambda x: jvm.java.nio.file.Paths.get(fs.makeQualified(x).toUri())
                jvm.java.nio.file.Files.createLink(local(at), local(aside))
            else:
                plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(aside, at, plain)
        except Exception as e:
            if fs.exists(at):
                raise Conflict(f"version {version} was committed by another writer; read again and retry") from e
            raise
        finally:
            fs.delete(aside, False)
        return version
