"""Versions of something in a shared folder, each published by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder whose state is its newest ``version-N.json``.

    A version is written to a file of another name and renamed, which is
    atomic on file systems such as HDFS; a number that is taken is refused.
    Readers see the old state or the new one. Stores without atomic rename
    need one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._io = jvm.org.apache.commons.io.IOUtils
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))

    def names(self, pattern: str = "*") -> list[str]:
        """Names in the folder."""
        return [s.getPath().getName() for s in self._fs.globStatus(self._at(f"{self.path}/{pattern}")) or []]

    def versions(self) -> list[int]:
        return sorted(int(n[8:-5]) for n in self.names("version-*.json"))

    def version(self) -> int:
        """The newest published version, 0 before the first."""
        return max([0, *self.versions()])

    def read_bytes(self, name: str) -> bytes:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return bytes(self._io.toByteArray(stream))
        finally:
            stream.close()

    def state(self, version: int | None = None) -> dict:
        """The body of a version (the newest), empty before the first."""
        version = self.version() if version is None else version
        return json.loads(self.read_bytes(f"version-{version}.json")) if version else {}

    def publish(self, version: int, state: dict) -> None:
        """Publish a version that doesn't exist yet; RuntimeError if another writer was first."""
        self.publish_bytes(version, json.dumps(state).encode())

    def publish_bytes(self, version: int, data: bytes) -> None:
        temp = f".pending-{uuid.uuid4().hex}"
        self.write_bytes(temp, data)
        final = self._at(f"{self.path}/version-{version}.json")
        if self._fs.exists(final) or not self._fs.rename(self._at(f"{self.path}/{temp}"), final):
            self.delete(temp)
            raise RuntimeError(f"version {version} was published by another run")

    def write_bytes(self, name: str, data: bytes) -> None:
        out = self._fs.create(self._at(f"{self.path}/{name}"), False)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()

    def appender(self, name: str):
        """A new file to write to bit by bit; ``hsync`` makes what was written durable.

        On a local file system without its checksum files, which would hold back the last bytes.
        """
        uri = self._at(self.path).toUri()
        fs = self._fs.newInstance(uri, self._fs.getConf()) if uri.getScheme() is not None else self._fs
        if uri.getScheme() in (None, "file"):
            fs.setWriteChecksum(False)
        return fs.create(self._at(f"{self.path}/{name}"), False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)

    def size(self, name: str = "") -> int:
        """Bytes of all files in the folder, or in one below it."""
        return self._fs.getContentSummary(self._at(f"{self.path}/{name}".rstrip("/"))).getLength()
