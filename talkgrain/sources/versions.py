"""Versions of a table in a folder: each is one small manifest, taken by compare-and-swap."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer took the version this one was made for."""


class Versions:
    """Manifests `versions/<n>.json` under a root; the highest number is current.

    A manifest is written under another name and renamed without overwriting, so that of two writers from one version
    only one succeeds, and readers see all of a commit or nothing of it.
    """

    KEPT = 5

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._dir = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        self.fs = self._dir.getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)

    def path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self._dir):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._dir)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> tuple[int, dict]:
        """Number and content of the current version; 0 and nothing before the first."""
        numbers = self.numbers()
        if not numbers:
            return 0, {}
        stream = self.fs.open(self.path(f"{self.root}/versions/{numbers[-1]:012d}.json"))
        try:
            return numbers[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, made_from: int, manifest: dict) -> int:
        """Make the manifest the version after made_from; Conflict if there is one already."""
        tmp = self.path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(tmp, self.path(f"{self.root}/versions/{made_from + 1:012d}.json"), none)
        except Exception as e:  # py4j wraps what the file system throws
            self.fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {made_from + 1} of {self.root} was taken by another writer") from None
            raise
        for n in self.numbers()[: -self.KEPT]:
            self.fs.delete(self.path(f"{self.root}/versions/{n:012d}.json"), False)
        return made_from + 1

    def change(self, make: Callable[[dict], dict], tries: int = 20) -> dict:
        """Commit what `make` makes of the current manifest, anew if another writer came first."""
        for _ in range(tries):
            number, manifest = self.current()
            out = make(manifest)
            try:
                self.commit(number, out)
                return out
            except Conflict:
                continue
        raise Conflict(f"no version of {self.root} could be taken in {tries} tries")

    def sweep(self, folders: list[str], used: list[str]) -> None:
        """Delete what lies in the folders (under the root) and neither is nor holds any path that is used."""
        for folder in folders:
            at = self.path(f"{self.root}/{folder}")
            for s in self.fs.listStatus(at) if self.fs.exists(at) else []:
                p = f"{self.root}/{folder}/{s.getPath().getName()}"
                if not any(u == p or u.startswith(p + "/") for u in used):
                    self.fs.delete(s.getPath(), True)
