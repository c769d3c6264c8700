"""Ticks as micro-batches: each folds its postings into the stored state.

State lives in versions, one folder per batch, and a batch writes its own from its predecessor's; a batch that is
run again after a failure starts from the same predecessor and writes the same rows, so every batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.match import match
from heddle.operators.state import KEY, STATE, tick
from heddle.profile import Profile


def _versions(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in done)


def current_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest state, or the newest before a version; empty where there is none."""
    found = [v for v in _versions(spark, folder) if before is None or v < before]
    if not found:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{folder}/version={found[-1]}")


def fold(folder: str, ledger: Callable[[], DataFrame], profile: Profile | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function. Batches hold key, posting columns, seq and ``now``, which is one value per batch."""

    def run(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        now = batch.agg(F.max("now")).first()[0]
        if now is None:
            return
        fresh = match(batch, profile).withColumn("matched", F.col("matched").cast("int")) if profile else batch
        state = tick(current_state(spark, folder, before=version), fresh, ledger(), now)
        state.drop("is_new").write.mode("overwrite").parquet(f"{folder}/version={version}")

    return run


def start(stream: DataFrame, folder: str, checkpoint: str, ledger: Callable[[], DataFrame], profile: Profile | None = None):
    """Runs all that the stream holds now, a file per micro-batch if its source is set so, and returns the query."""
    return stream.writeStream.foreachBatch(fold(folder, ledger, profile)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_keys(state: DataFrame, now: float) -> DataFrame:
    return state.where(F.col("first_seen") == now).select(*KEY)
