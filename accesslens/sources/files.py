"""Small files of a table's own bookkeeping, on whatever file system holds the table."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of small text files, some of which may be claimed by one writer only."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._root = self._path(path)
        self._system = self._root.getFileSystem(self._conf)

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _child(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def names(self) -> list[str]:
        """Files and folders in it; none if it does not exist. Hidden ones are left out."""
        if not self._system.exists(self._root):
            return []
        found = [status.getPath().getName() for status in self._system.listStatus(self._root)]
        return [name for name in found if not name.startswith(("_", "."))]

    def text(self, name: str) -> str:
        stream = self._system.open(self._child(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Create the file with this text, whole, unless it exists; True for one of all claimants only.

        The text is written beside it and given the name in one step that fails where the name is
        taken: a hard link on a local file system, elsewhere a rename without overwriting, which
        HDFS makes atomic.
        """
        draft, target = self._child(f"_draft-{uuid.uuid4().hex}"), self._child(name)
        self._system.mkdirs(self._root)
        stream = self._system.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if target.getFileSystem(self._conf).getScheme() == "file":
                self._link(draft, target)
            else:
                self._rename(draft, target)
            return True
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._system.delete(draft, False)

    def _link(self, draft, target) -> None:
        def local(path):
            return self._jvm.java.io.File(path.toUri().getPath()).toPath()

        self._jvm.java.nio.file.Files.createLink(local(target), local(draft))

    def _rename(self, draft, target) -> None:
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(draft, target, options)
