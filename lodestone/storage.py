"""Versioned tables: each version is an immutable list of Parquet folders and files, published by swapping one pointer.

A store that is given its root keeps a manifest there, a JSON file for each publication, written aside and renamed to the next number. The
rename fails if another process has taken that number, so of two writers one gets a serialization failure; a store opened on the
same root later begins with the last manifest.
"""

from __future__ import annotations

import json
import os
import tempfile
import threading
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import EngineError, TransactionError


def shared_folder(spark: SparkSession) -> str:
    """Where versions are written: the cluster's checkpoint folder, or, in local mode alone, one of this machine where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise EngineError("spark.checkpoint.dir must name a folder that all executors share", "55000")
    return named or os.path.join(tempfile.gettempdir(), "checkpoints")


@dataclass(frozen=True)
class Version:
    number: int
    schema: T.StructType
    folders: tuple[str, ...]
    batches: tuple[tuple[str, int], ...] = ()  # the last micro-batch of each stream that it holds


@dataclass
class Store:
    """Tables and their versions. Readers hold a Version and so a snapshot; writers publish against the version they read."""

    spark: SparkSession
    root: str = ""
    tables: dict[str, list[Version]] = field(default_factory=dict)
    saved: dict[str, str] = field(default_factory=dict)  # what sessions keep beside the tables
    lock: threading.RLock = field(default_factory=threading.RLock)
    durable: bool = False
    number: int = 0  # of the last manifest

    def __post_init__(self) -> None:
        self.durable = bool(self.root)
        self.root = self.root or f"{shared_folder(self.spark)}/lodestone/{uuid.uuid4().hex}"
        if self.durable:
            self.reload()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def reload(self) -> None:
        """Take over the last manifest, if there is one."""
        folder = self._path(f"{self.root}/_manifests")
        files = self._files(folder)
        names = sorted(x.getPath().getName() for x in files.listStatus(folder)) if files.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return
        kept = json.loads(self.spark.read.text(f"{self.root}/_manifests/{names[-1]}", wholetext=True).first()[0])
        one = lambda v: Version(v["number"], T.StructType.fromJson(v["schema"]), tuple(v["folders"]), tuple(map(tuple, v["batches"])))
        self.number, self.tables, self.saved = int(names[-1].split(".")[0]), {n: [one(v) for v in vs] for n, vs in kept["tables"].items()}, kept["saved"]

    def _commit(self, tables: dict[str, list[Version]], saved: dict[str, str]) -> None:
        """The new state, on disk before it is seen."""
        if self.durable:
            one = lambda v: {"number": v.number, "schema": v.schema.jsonValue(), "folders": list(v.folders), "batches": [list(b) for b in v.batches]}
            text = json.dumps({"tables": {n: [one(v) for v in vs] for n, vs in tables.items()}, "saved": saved})
            aside, final = self._path(f"{self.root}/_manifests/{uuid.uuid4().hex}.new"), self._path(f"{self.root}/_manifests/{self.number + 1:012d}.json")
            jvm, files = self.spark.sparkContext._jvm, self._files(aside)
            out = files.create(aside)
            out.write(bytearray(text.encode()))
            out.close()
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(final).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            try:
                context.rename(files.makeQualified(aside), files.makeQualified(final), options)
            except Exception as taken:
                files.delete(aside, False)
                if "AlreadyExists" not in str(taken):
                    raise
                self.reload()
                raise TransactionError("another process has published in between", "40001") from taken
            self.number += 1
        self.tables, self.saved = tables, saved

    def save(self, saved: dict[str, str]) -> None:
        """Keep texts beside the tables."""
        with self.lock:
            if self.durable and any(self.saved.get(k) != v for k, v in saved.items()):
                self._commit(self.tables, self.saved | saved)

    def remove(self, folders: Iterable[str]) -> None:
        for folder in folders:
            path = self._path(folder)
            self._files(path).delete(path, True)

    def write(self, df: DataFrame) -> str:
        folder = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def read(self, version: Version, spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        if not version.folders:
            return spark.createDataFrame([], version.schema)
        return spark.read.schema(version.schema).parquet(*version.folders)

    def files(self, version: Version) -> list[str]:
        """The paths of a version's files."""
        out = []
        for f in version.folders:
            path = self._path(f)
            out += [f] if f.endswith(".parquet") else [f"{f}/{x.getPath().getName()}" for x in self._files(path).listStatus(path) if x.getPath().getName().endswith(".parquet")]
        return out

    def size(self, version: Version) -> int:
        """Bytes of a version's files."""
        paths = [self._path(f) for f in version.folders]
        return sum(self._files(p).getContentSummary(p).getLength() for p in paths)

    def latest(self, name: str) -> Version | None:
        versions = self.tables.get(name)
        return versions[-1] if versions else None

    def snapshot(self) -> dict[str, Version]:
        with self.lock:
            return {name: versions[-1] for name, versions in self.tables.items() if versions}

    def publish(self, changes: dict[str, tuple[Version | None, Version | None]], saved: dict[str, str] | None = None) -> None:
        """All of changes, name -> (version it builds on, new version or None to drop), or none if a base is no longer the latest."""
        with self.lock:
            for name, (base, _) in changes.items():
                if self.latest(name) != base:
                    raise TransactionError(f"could not serialize access to {name}", "40001")
            tables = {name: list(versions) for name, versions in self.tables.items()}
            for name, (_, new) in changes.items():
                if new is None:
                    tables.pop(name, None)
                else:
                    tables.setdefault(name, []).append(new)
            self._commit(tables, self.saved | (saved or {}))

    def as_of(self, name: str, number: int) -> Version:
        for version in self.tables.get(name, ()):
            if version.number == number:
                return version
        raise TransactionError(f"{name} has no version {number}", "42704")

    def prune(self, name: str, keep: int = 1) -> int:
        """Forget all but the last `keep` versions; what none of the kept ones names, or names a file of, is deleted."""
        with self.lock:
            versions = self.tables.get(name, [])
            gone = versions[:-keep]
            if gone:
                self._commit(self.tables | {name: versions[-keep:]}, self.saved)
            used = {f for vs in self.tables.values() for v in vs for f in v.folders}
        used |= {f.rpartition("/")[0] for f in used if f.endswith(".parquet")}  # folders of which a file is used
        self.remove({f for v in gone for f in v.folders} - used)
        return len(gone)
