"""Versioned snapshots: sets of tables that appear at once, replace each other, and are read by any session.

Below the folder of a store:

data/<id>/<table>     the tables of a version, or of a writer that has not come to its end
commits/<number>.json what a version is made of; the highest one that can be read is the current version

A version is visible when its commit is there, so a reader has all tables of one version.  Commits are made by
exclusive creation, which HDFS and stores with the same promise decide between writers; the latest wins.
A commit tells the last batch of each stream, and a batch that comes again adds nothing.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from linkgraph.sources.shared import hadoop_path

#: Versions that stay readable, and seconds after which tables without a commit are an ended writer's.
KEEP, ABANDONED = 3, 86_400
_LOCK = threading.Lock()


@dataclass(frozen=True)
class Version:
    """A committed version: its number, the folder of its tables, their schemas, the last batch by stream."""

    number: int
    data: str
    tables: Mapping[str, str]
    batches: Mapping[str, int]
    time: float


class SnapshotStore:
    """The versions below a folder that all readers and writers share."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = KEEP, abandoned: float = ABANDONED):
        if keep < 1:
            raise ValueError("a store keeps one version at least")
        self.spark, self.folder, self.keep, self.abandoned = spark, folder.rstrip("/"), keep, abandoned
        self.fs, _ = hadoop_path(spark, self.folder)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _numbers(self) -> list[int]:
        """Numbers that commits have, the latest first; of those that can't be read, too."""
        folder = self._path("commits")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _read(self, number: int) -> Version | None:
        """A commit, or None where it isn't whole (a writer was lost between creating and writing it)."""
        try:
            told = self.fs.open(self._path(f"commits/{number:020d}.json"))
            try:
                text = bytes(told.readAllBytes()).decode()
            finally:
                told.close()
            return Version(**json.loads(text))
        except (Py4JJavaError, ValueError, TypeError):
            return None

    def versions(self) -> list[Version]:
        """The versions that can be read, the latest first."""
        return [v for v in map(self._read, self._numbers()) if v]

    def latest(self) -> Version | None:
        return next((v for v in map(self._read, self._numbers()) if v), None)

    def table(self, name: str, version: Version | None = None) -> DataFrame:
        """A table of a version, by default of the current one."""
        version = version or self.latest()
        if version is None or name not in version.tables:
            raise KeyError(name)
        return self.spark.read.schema(StructType.fromJson(json.loads(version.tables[name]))).parquet(f"{self.folder}/data/{version.data}/{name}")

    def known(self, batch: tuple[str, int] | None) -> bool:
        """Whether a batch (stream, number) is part of the current version."""
        now = self.latest() if batch else None
        return now is not None and now.batches.get(batch[0], -1) >= batch[1]

    def commit(self, write: Callable[[str], Mapping[str, StructType] | None], batch: tuple[str, int] | None = None) -> Version | None:
        """Make a version of the tables that ``write`` writes below the path it is given; it returns their
        schemas by name, or None for the tables of the current version.  None, and nothing is left, if the batch is known; then ``write`` isn't even called,
        unless another writer commits the batch meanwhile."""
        if self.known(batch):
            return None
        data = uuid.uuid4().hex
        schemas = write(f"{self.folder}/data/{data}")
        with _LOCK:  # writers of one process; others meet at the exclusive creation
            while True:
                if self.known(batch):
                    self.fs.delete(self._path(f"data/{data}"), True)
                    return None
                now = self.latest()
                batches = dict(now.batches) if now else {}
                if batch:
                    batches[batch[0]] = batch[1]
                number = max([*self._numbers()[:1], 0]) + 1
                made = (now.data, now.tables) if schemas is None else (data, {n: s.json() for n, s in schemas.items()})
                version = Version(number, *made, batches, time.time())
                if self._create(f"commits/{number:020d}.json", json.dumps(version.__dict__)):
                    break
        self.vacuum()
        return version

    def _create(self, name: str, text: str) -> bool:
        path = self._path(name)
        try:
            out = self.fs.create(path, False)
        except Py4JJavaError:
            if self.fs.exists(path):
                return False  # another writer was first
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def save(self, tables: Mapping[str, DataFrame], batch: tuple[str, int] | None = None) -> Version | None:
        """``commit`` of frames that are independent of each other."""

        def write(path: str) -> dict[str, StructType]:
            for name, rows in tables.items():
                rows.write.parquet(f"{path}/{name}")
            return {name: rows.schema for name, rows in tables.items()}

        return self.commit(write, batch)

    def vacuum(self) -> None:
        """Delete versions beyond ``keep``, and tables without a commit that are older than ``abandoned``."""
        versions = self.versions()
        kept = {v.data for v in versions[: self.keep]}
        for old in versions[self.keep :]:
            self.fs.delete(self._path(f"commits/{old.number:020d}.json"), False)
            if old.data not in kept:  # versions may share their tables
                self.fs.delete(self._path(f"data/{old.data}"), True)
        held = {v.data for v in self.versions()}
        now = time.time()
        folder = self._path("data")
        for found in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
            if found.getPath().getName() not in held and now - found.getModificationTime() / 1000 > self.abandoned:
                self.fs.delete(found.getPath(), True)
