"""Small files on any store that Spark can write to, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes a file beside the old one, then renames it over: readers see the old or the new text."""
        draft = f"{name}.tmp-{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(draft), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        how[0] = rename.OVERWRITE
        context.rename(self._path(draft), self._path(name), how)

    @contextmanager
    def lock(self, name: str, wait_s: float = 60, stale_s: float = 600) -> Iterator[None]:
        """Holds a file that only one writer can create; one that was left behind for ``stale_s`` is taken over."""
        path, until = self._path(name), time.monotonic() + wait_s
        while not self._created(path):
            age = time.time() - self.fs.getFileStatus(path).getModificationTime() / 1000 if self.fs.exists(path) else 0
            if age > stale_s:
                self.fs.delete(path, False)
            elif time.monotonic() > until:
                raise TimeoutError(f"{self.uri(name)} is held by another writer")
            else:
                time.sleep(0.05)
        try:
            yield
        finally:
            self.fs.delete(path, False)

    def _created(self, path) -> bool:
        if self.fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
            return self.jvm.java.io.File(path.toUri().getPath()).createNewFile()
        try:
            self.fs.create(path, False).close()
        except Py4JJavaError:
            if self.fs.exists(path):
                return False
            raise
        return True

    def move(self, name: str, to: str) -> None:
        self.fs.mkdirs(self._path(to).getParent())
        if not self.fs.rename(self._path(name), self._path(to)):
            raise OSError(f"can't move {self.uri(name)} to {self.uri(to)}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def make(self) -> None:
        self.fs.mkdirs(self._path(""))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def listing(self) -> list[str]:
        """All regular files below the root, with paths relative to it; drafts and hidden files aside."""
        if not self.fs.exists(self._path("")):
            return []
        out, found = [], self.fs.listFiles(self._path(""), True)
        base = self.fs.makeQualified(self._path("")).toString().rstrip("/") + "/"
        while found.hasNext():
            name = found.next().getPath().toString().removeprefix(base)
            if ".tmp-" not in name and not name.endswith(".lock") and not any(p.startswith((".", "_")) for p in name.split("/")):
                out.append(name)
        return sorted(out)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that every executor sees, which goes when the driver ends.

    A local temporary one only in local mode with none configured; an error on a cluster.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidewright-")
    files = Files(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    files.make()
    files.fs.deleteOnExit(files._path(""))
    return files.root
