"""Snapshots as a data source: a write takes effect when its manifest appears, and then as a whole.

``df.write.format("snapshot").mode("overwrite").save(path)`` writes Parquet files under names of its own; each task reports its
file to the driver, which puts the next manifest in place by renaming it once it is written. A reader takes the newest
manifest and the files it names, so it sees the snapshot before or after, never neither. A write that fails deletes what
its tasks reported. ``append`` keeps the present files. The last ``keep`` manifests and their files stay for readers that
have begun; one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    at = "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return FileSystem.from_uri(at if "://" in at else f"file://{at}")


def _versions(path: str) -> list[int]:
    from pyarrow.fs import FileSelector

    fs, base = _filesystem(path)
    names = [f.base_name for f in fs.get_file_info(FileSelector(f"{base}/manifests", allow_not_found=True))]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(path: str, version: int | None = None) -> dict:
    """{version, schema, files}; version 0 where nothing was written."""
    found = [version] if version else _versions(path)
    if not found:
        return {"version": 0, "schema": None, "files": []}
    fs, base = _filesystem(path)
    with fs.open_input_stream(f"{base}/manifests/{found[-1]:012d}.json") as told:
        return json.loads(told.read())


class SnapshotSource(DataSource):
    """Options: the path of ``save`` or ``load``; ``keep``, of how many versions files stay; ``version``, to read an older one."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> StructType:
        told = self._manifest()
        if not told["version"]:
            raise ValueError(f"no snapshot at {self.options['path']}")
        return StructType.fromJson(told["schema"])

    def _manifest(self) -> dict:
        return manifest(self.options["path"], int(self.options.get("version", 0)) or None)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SnapshotReader(self.options["path"], self._manifest()["files"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SnapshotWriter(self.options["path"], schema, overwrite, int(self.options.get("keep", 2)))


class FilePartition(InputPartition):
    def __init__(self, name: str):
        super().__init__(None)
        self.name = name


class SnapshotReader(DataSourceReader):
    def __init__(self, path: str, files: list[str]):
        self.path, self.files = path, files

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(f) for f in self.files] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        from pyarrow.parquet import ParquetFile

        if partition.name:
            fs, base = _filesystem(self.path)
            with fs.open_input_file(f"{base}/{partition.name}") as file:
                yield from ParquetFile(file).iter_batches()


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class SnapshotWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, keep: int):
        self.path, self.schema, self.overwrite, self.keep = path, schema.jsonValue(), overwrite, keep
        self.old = manifest(path)
        self.home = f"data/{self.old['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow.parquet import ParquetWriter

        writer, rows, name = None, 0, f"{self.home}/part-{uuid.uuid4().hex}.parquet"
        fs, base = _filesystem(self.path)
        try:
            for batch in iterator:
                if writer is None:
                    fs.create_dir(f"{base}/{self.home}", recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}")
                    writer = ParquetWriter(out, batch.schema, compression="zstd")
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
                out.close()
        return Written(name if writer is not None else None, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _filesystem(self.path)
        version = self.old["version"] + 1
        files = ([] if self.overwrite else self.old["files"]) + [m.name for m in messages if m and m.name]
        fs.create_dir(f"{base}/manifests", recursive=True)
        fresh = f"{base}/manifests/.{uuid.uuid4().hex}"
        with fs.open_output_stream(fresh) as out:
            out.write(json.dumps({"version": version, "schema": self.schema, "files": files}).encode())
        fs.move(fresh, f"{base}/manifests/{version:012d}.json")
        self._forget(fs, base, version)

    def _forget(self, fs, base: str, newest: int) -> None:
        """Files that only manifests before the last ``keep`` name, and those of earlier writes that failed."""
        from pyarrow.fs import FileSelector

        found = _versions(self.path)
        kept = {f for v in found[-self.keep :] for f in manifest(self.path, v)["files"]}
        for f in fs.get_file_info(FileSelector(f"{base}/data", recursive=True, allow_not_found=True)):
            name = f"data/{f.path.rsplit('/data/', 1)[1]}"
            if f.is_file and name not in kept and int(name.split("/")[1].split("-")[0]) <= newest:
                fs.delete_file(f.path)
        for v in found[: -self.keep]:
            fs.delete_file(f"{base}/manifests/{v:012d}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _filesystem(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{base}/{m.name}")


def write_snapshot(df: DataFrame, path: str, keep: int = 2) -> None:
    """Replaces the snapshot at a path at once; readers see the old one or the new one."""
    df.sparkSession.dataSource.register(SnapshotSource)
    df.write.format("snapshot").mode("overwrite").option("keep", keep).save(path)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The snapshot as it is now, or an older version of it. What is read is settled here, not when an action runs, so that a
    write in between changes neither its columns nor its rows."""
    spark.dataSource.register(SnapshotSource)
    reader, version = spark.read.format("snapshot"), version or manifest(path)["version"]
    return (reader.option("version", version) if version else reader).load(path)
