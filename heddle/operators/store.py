"""Stored state in hash buckets: a batch rewrites the buckets that it touches, and a manifest's appearance is the commit.

A store is a folder of Parquet, one sub-folder for each bucket and version of it, and of manifests, one for each version of
the whole, which name every bucket's present folder. A commit writes new folders for the touched buckets, then puts the next
manifest in place by a rename that fails if another writer was faster. So a reader sees the old state or the new one, a
failed batch leaves only files that no manifest names, and what is written follows the batch, not the state. A batch that
carries a number is applied once: its number stands in the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(Exception):
    """Another writer committed the version that this one was about to."""


@dataclass(frozen=True)
class BucketStore:
    """``schema`` of the rows, ``by`` the columns whose hash names a row's bucket. Rows that a merge looks at together must
    agree in ``by``. ``buckets`` is fixed for a store's life."""

    spark: SparkSession
    folder: str
    schema: str
    by: tuple[str, ...]
    buckets: int = 256

    def _fs(self, path: str = ""):
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}" if path else self.folder)
        return at, at.getFileSystem(sc._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._fs("manifests")
        if not fs.exists(at):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(at))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """{version, batch, files: bucket to folder}; version 0, of no files, where nothing was committed."""
        found = self.versions() if version is None else [version]
        if not found or found[-1] == 0:
            return {"version": 0, "batch": None, "files": {}}
        at, fs = self._fs(f"manifests/{found[-1]:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default, or of some buckets of it."""
        return self._read(self.manifest(version), only)

    def _read(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        folders = [f"{self.folder}/{path}" for b, path in manifest["files"].items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def apply(self, changes: DataFrame, merge: Merge, batch: int | None = None) -> set[int] | None:
        """Replaces the touched buckets by ``merge(their rows, changes)``; returns them, or None for a batch applied before.

        ``changes`` may have other columns than the store, but must have those of ``by``.
        """
        old = self.manifest()
        if batch is not None and old["batch"] is not None and batch <= old["batch"]:
            return None
        changes = changes.persist()
        try:
            touched = {r[0] for r in changes.select(self.bucket()).distinct().collect()}  # at most ``buckets`` numbers
            self._commit(old, touched, merge(self._read(old, touched), changes), batch)
        finally:
            changes.unpersist()
        return touched

    def rewrite(self, change: Callable[[DataFrame], DataFrame], batch: int | None = None) -> None:
        """Replaces all buckets by ``change`` of all rows: for deletes and other changes that no batch of keys names."""
        old = self.manifest()
        self._commit(old, set(range(self.buckets)), change(self._read(old)), batch)

    def _commit(self, old: dict, touched: set[int], rows: DataFrame, batch: int | None) -> None:
        version = old["version"] + 1
        columns = self.spark.createDataFrame([], self.schema).columns
        home = f"data/{version:012d}-{uuid.uuid4().hex[:8]}"
        if touched:
            # Rows of a bucket come together, but a bucket that has most of them is dealt to several tasks.
            bucketed = rows.select(*columns, self.bucket().alias("bucket")).hint("rebalance", "bucket")
            bucketed.write.partitionBy("bucket").parquet(f"{self.folder}/{home}")
        at, fs = self._fs(home)
        made = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(at) if s.isDirectory()} if touched else set()
        files = {b: path for b, path in old["files"].items() if int(b) not in touched} | {b: f"{home}/bucket={b}" for b in made}
        self._put({"version": version, "batch": old["batch"] if batch is None else batch, "files": files})

    def _put(self, manifest: dict) -> None:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        target, _ = self._fs(f"manifests/{manifest['version']:012d}.json")
        fresh, fs = self._fs(f"manifests/.{manifest['version']:012d}-{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fresh, target, options)
        except (Py4JJavaError, PySparkException) as error:
            fs.delete(fresh, False)
            if fs.exists(target):
                raise Conflict(f"version {manifest['version']} of {self.folder} is there already") from error
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the manifests before the last ``keep``, and the folders that only those name; returns the folders' number.

        Readers of a deleted version fail, so ``keep`` must cover the longest read. Folders of commits that are under way or
        failed have versions beyond the newest manifest and stay until it is theirs.
        """
        found = self.versions()
        old, kept = found[:-keep], [self.manifest(v) for v in found[-keep:]]
        named = {path for m in kept for path in m["files"].values()}
        gone = 0
        root, fs = self._fs("data")
        for s in fs.listStatus(root) if found and fs.exists(root) else ():
            home = s.getPath().getName()
            if int(home.split("-")[0]) > found[-1]:
                continue
            for b in fs.listStatus(s.getPath()):
                if f"data/{home}/{b.getPath().getName()}" not in named and b.isDirectory():
                    fs.delete(b.getPath(), True)
                    gone += 1
            if not any(x.isDirectory() for x in fs.listStatus(s.getPath())):
                fs.delete(s.getPath(), True)
        for v in old:
            fs.delete(self._fs(f"manifests/{v:012d}.json")[0], False)
        return gone


def upsert(*key: str) -> Merge:
    """The changed row in place of the stored one with its key; of several changes of a key one must have been picked."""

    def merge(rows: DataFrame, changes: DataFrame) -> DataFrame:
        return rows.join(changes.select(*key), list(key), "left_anti").unionByName(changes.select(*rows.columns))

    return merge


def insert_absent(*key: str) -> Merge:
    """Only changes whose key is not stored yet."""

    def merge(rows: DataFrame, changes: DataFrame) -> DataFrame:
        return rows.unionByName(changes.join(rows.select(*key), list(key), "left_anti").select(*rows.columns))

    return merge
