"""A landing table of fetched pages with an age limit: what is fresh is read, the rest is fetched and added.

Pages lie in folders by the day of their fetch, so that a read within the age limit touches only the days that it may use.
A board's pages count together: its newest fetch that ended without an error, if that is young enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.sources.reader import PAGES, fetch

DAY = 86_400
LANDED = PAGES.replace("now double", "fetched_at double") + ", fetched_day long"
_BOARD = ["ats", "token"]


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """All pages ever landed; no rows where nothing is there yet."""
    return spark.read.schema(LANDED).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], LANDED)


def land(pages: DataFrame, folder: str, now: float) -> None:
    """Adds fetched pages, errors too, under the day of ``now``."""
    stamped = pages.drop("now").withColumns({"fetched_at": F.lit(float(now)), "fetched_day": F.lit(int(now // DAY)).cast("long")})
    stamped.write.mode("append").partitionBy("fetched_day").parquet(folder)


def fresh(pages: DataFrame, now: float, max_age: float) -> DataFrame:
    """The pages of each board's newest whole fetch that is younger than ``max_age`` seconds at ``now``.

    A page that was landed twice in one fetch comes once. Fetches after ``now`` do not count.
    """
    young = pages.where((F.col("fetched_day") >= int((now - max_age) // DAY)) & (F.col("fetched_day") <= int(now // DAY)) & (F.col("fetched_at") > now - max_age) & (F.col("fetched_at") <= now))
    fetches = young.groupBy(*_BOARD, "fetched_at").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"))
    newest = fetches.where("not failed").groupBy(*_BOARD).agg(F.max("fetched_at").alias("fetched_at"))
    return young.join(newest, [*_BOARD, "fetched_at"], "left_semi").dropDuplicates([*_BOARD, "page_offset"])


def read_through(boards: DataFrame, folder: str, now: float, max_age: float, **options) -> DataFrame:
    """The pages of all ``boards``: fresh ones from the landing table, the others fetched now and landed first.

    Boards whose fetch fails come with their error, and older pages of theirs are not used. The fetch happens here, once; the
    result reads the landing table.
    """
    spark = boards.sparkSession
    wanted = boards.where("ats is not null and token is not null")
    have = fresh(landed(spark, folder), now, max_age)
    missing = wanted.join(have.select(*_BOARD).distinct(), _BOARD, "left_anti")
    land(fetch(missing, now, **options), folder, now)
    after = landed(spark, folder)
    failed = after.where((F.col("fetched_day") == int(now // DAY)) & (F.col("fetched_at") == float(now)))
    failed = failed.join(failed.where("error is not null").select(*_BOARD).distinct(), _BOARD, "left_semi")
    found = fresh(after, now, max_age).unionByName(failed)
    return found.join(wanted.select(*_BOARD).distinct(), _BOARD, "left_semi")


def forget(spark: SparkSession, folder: str, before: float) -> list[int]:
    """Deletes whole days that ended before a time; returns them. Days are whole folders, so nothing is rewritten."""
    if not _exists(spark, folder):
        return []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    days = [(int(s.getPath().getName().partition("=")[2]), s.getPath()) for s in fs.listStatus(root) if s.getPath().getName().startswith("fetched_day=")]
    old = [(d, p) for d, p in days if (d + 1) * DAY <= before]
    for _, path in old:
        fs.delete(path, True)
    return sorted(d for d, _ in old)
