"""Versions of a folder on shared storage: each is a small JSON file that becomes visible whole, and to one writer only."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class PublishedElsewhere(RuntimeError):
    """The version was published by another run."""


class Manifests:
    """``_manifests/v<n>.json`` below ``path``.

    A manifest is written under a name of its own and then given its final name, which fails if that exists: by a hard
    link on local and mounted file systems, by a rename without overwriting on HDFS. So of two writers of one version
    exactly one succeeds, and the other has changed nothing that a reader can see. An object store that has neither
    needs a lock beside it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def newest(self) -> int:
        """The newest published version, -1 before the first."""
        folder = self.at("_manifests")
        if not self._fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=-1)

    def read(self, version: int) -> dict:
        stream = self._fs.open(self.at(f"_manifests/v{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, version: int, content: dict) -> None:
        """Publishes ``content`` as a version; raises ``PublishedElsewhere``, and changes nothing, if it exists."""
        data = json.dumps(content).encode()
        folder, draft, final = self.at("_manifests"), f"_manifests/.{uuid.uuid4().hex}", self.at(f"_manifests/v{version}.json")
        self._fs.mkdirs(folder)
        if self._fs.getUri().getScheme() == "file":
            source, target = (self.at(n).toUri().getPath() for n in (draft, f"_manifests/v{version}.json"))
            with open(source, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(source, target)
            except FileExistsError as e:
                raise PublishedElsewhere(f"version {version} was published by another run") from e
            finally:
                os.unlink(source)
            return
        out = self._fs.create(self.at(draft), False)
        out.write(bytearray(data))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(self.at(draft), final):
            self._fs.delete(self.at(draft), False)
            raise PublishedElsewhere(f"version {version} was published by another run")

    def remove(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def children(self, name: str) -> list[str]:
        folder = self.at(name)
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []


class Runs(Manifests):
    """Numbered runs, each a folder of its own; publishing a run again replaces the whole of it."""

    def entries(self) -> dict[int, dict]:
        version = self.newest()
        return {} if version < 0 else {int(k): v for k, v in self.read(version)["runs"].items()}

    def put(self, run: int, entry: dict, instead_of: tuple[int, ...] = ()) -> None:
        """Lists ``entry`` as the run, in place of what was listed under its number and of the runs ``instead_of``.
        Writers of different runs do not hinder each other: who comes second adds to what the first has published."""
        while True:
            version = self.newest()
            runs = {k: v for k, v in self.entries().items() if k != run and k not in instead_of} | {run: entry}
            try:
                return self.publish(version + 1, {"runs": runs})
            except PublishedElsewhere:
                continue
