"""What the operators of this subpackage share: scratch tables, package shipping, checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]

#: ASCII white space, the word separator of every operator here that counts or shingles words.
WORD = r"[^\x20\x09-\x0D]+"

_local_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may leave it unset (tests); it then gets a temporary folder.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = "file://" + tempfile.mkdtemp(prefix="heddle-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/heddle-{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system API; a stopped session is left alone."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        if path.startswith("file:///tmp/"):
            import shutil

            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it again.

    The files outlive any executor, and a later reader takes only the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they run (once per application).

    The archive is made beside the driver; Spark's own file server hands it to the executors.
    """
    sc = spark.sparkContext
    if getattr(sc, "_heddle_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="heddle-zip-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(PACKAGE.rglob("*.py")):
            out.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
    sc.addPyFile(str(path))
    sc._heddle_shipped = True


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when a count proves that ``df`` has at most ``max_rows`` rows; else plain."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(max_rows + 1)) <= max_rows else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores after it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keyed(docs: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """``docs`` with a column ``key`` that no two rows share: a struct (none, id, digest, nth), none where the id is null.

    It orders as the ids do, null ids last, and is the same whenever it is computed, wherever the rows lie. Rows that agree in
    id and text are numbered in the order of a hash of all their columns, one task for each such pair that repeats;
    which of two wholly equal rows gets which number makes no difference.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))
    parts = [F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("digest")]
    pair, nth = unused(docs, f"{key}_pair"), unused(docs, f"{key}_nth")
    paired = docs.withColumn(pair, F.struct(*parts))

    def with_key(df: DataFrame, number: Column) -> DataFrame:
        return df.select(*docs.columns, F.struct(*(F.col(pair)[x].alias(x) for x in ("none", "id", "digest")), number.cast("int").alias("nth")).alias(key))

    repeated = paired.groupBy(pair).count().where("count > 1").select(pair)
    if not repeated.take(1):
        return with_key(paired, F.lit(1))
    repeated = materialise(repeated, "repeated")
    among = Window.partitionBy(pair).orderBy(F.xxhash64(*docs.columns))
    numbered = paired.join(repeated, pair, "left_semi").withColumn(nth, F.row_number().over(among))
    return with_key(paired.join(repeated, pair, "left_anti"), F.lit(1)).unionByName(with_key(numbered, F.col(nth)))


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_worker_memory: dict[str, dict] = {}


def worker_memory(owner: str) -> dict:
    """A dictionary that lasts as long as a Python worker serves one owner; those of other owners are let go.

    Spark reuses workers, so what one operator remembers would else stay beside the memory of the next.
    """
    if owner not in _worker_memory:
        _worker_memory.clear()
        give_back()
        _worker_memory[owner] = {}
    return _worker_memory[owner]


def give_back() -> None:
    """Hands freed memory back to the system: Arrow's and the C library's allocators keep what is freed for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def byte_slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows that hold at most ``most`` bytes together; a larger row is a run of its own."""
    first = held = 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(lengths):
        yield first, len(lengths)


def byte_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a binary column; null: 0."""
    return np.asarray(pc.fill_null(pc.binary_length(column), 0))
