"""File operations through Hadoop's file system layer, so that stores can lie wherever Spark can write."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path(base).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def folders(self, name: str) -> list[str]:
        """Names of the folders in a folder, in order; none if it does not exist."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)) if s.isDirectory())

    def read(self, name: str) -> str:
        """A file's text, or that of its new version where a crash came between taking the old one away and renaming."""
        if not self.exists(name):
            name = f"{name}.tmp"
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def written(self, name: str) -> bool:
        return self.exists(name) or self.exists(f"{name}.tmp")

    def write(self, name: str, text: str) -> None:
        """Writes beside the file and renames, so a reader sees the old or the new text.

        A version that was left beside the file by a crash while it was written is not read, as the old one is there.
        """
        beside = f"{name}.tmp"
        stream = self._fs.create(self._path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.delete(name)
        self.move(beside, name)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def move(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")
