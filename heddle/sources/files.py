"""Files: raw company lists, the exports of the company list, snapshots and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.names import text
from heddle.operators.resolve import summary
from heddle.sources.json_arrays import RANGE, elements

RAW_ENTRY = "company_name string, career_page_url string, website string, domain_hint string, ats_type string, source_platform string, board_token string, jobs_found long, slug string, location string"
#: The columns of the CSV export and of the files by source.
CSV_COLUMNS = ("company_name", "website", "career_page_url", "ats_type", "ats_source", "ats_conflict", "board_token", "domain_hint", "source_platforms", "is_mnc_flagged")
BY_SOURCE_COLUMNS = ("company_name", "website", "career_page_url", "board_token", "domain_hint", "source_platforms")


def read_entries(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Files that each hold a JSON array, in file-name order; seq orders entries over all of them.

    Files are read in ranges of ``size`` bytes, so that one file is many tasks; a file that is no array gives nothing.
    Nameless entries are dropped.
    """
    kind = f"struct<{', '.join(c.replace(' ', ':', 1) for c in RAW_ENTRY.split(', '))}>"
    rows = elements(spark, path, size).select((F.col("file_no") * F.lit(1 << 40) + F.col("at")).alias("seq"), F.from_json("value", kind).alias("e"))
    return rows.select("seq", "e.*").where("company_name is not null")


def _python_bool(c: Column) -> Column:
    return F.initcap(c.cast("string"))


def csv_rows(companies: DataFrame) -> DataFrame:
    """The CSV export's columns as text: lists joined by bars, no token as "", True and False."""
    as_text = {"ats_conflict": _python_bool(F.col("ats_conflict")), "is_mnc_flagged": _python_bool(F.col("is_mnc_flagged")), "board_token": text(F.col("board_token")), "source_platforms": F.array_join("source_platforms", "|")}
    return companies.withColumns(as_text).select(*CSV_COLUMNS)


def write_csv(companies: DataFrame, path: str) -> None:
    csv_rows(companies).write.mode("overwrite").option("header", True).csv(path)


def write_json(companies: DataFrame, path: str) -> None:
    companies.write.mode("overwrite").json(path)


def write_summary(companies: DataFrame, path: str) -> None:
    """The totals and the count of each source as one JSON record."""
    counts = companies.groupBy("ats_type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ats_type", "n")))).alias("by_ats"))
    summary(companies).join(F.broadcast(counts), F.lit(True), "left").coalesce(1).write.mode("overwrite").json(path)


def write_by_source(companies: DataFrame, path: str) -> None:
    """A folder of JSON files for each source."""
    companies.select("ats_type", *BY_SOURCE_COLUMNS).write.mode("overwrite").partitionBy("ats_type").json(path)


def write_snapshot(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A plain folder, written beside the target and renamed into its place once it is whole.

    Between the two renames a reader may find no folder; :func:`heddle.sources.snapshot.write_snapshot` has no such moment.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"))
    df.write.format(kind).save(fresh.toString())
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def log_lines(rows: DataFrame, *columns: str, most: int = 1000) -> DataFrame:
    """Log lines: fields without bars of their own, a bar between them, cut at ``most`` characters; 0 cuts none."""
    fields = [F.replace(text(F.col(c).cast("string")), F.lit("|"), F.lit("/")) for c in columns]
    line = F.concat_ws(" | ", *fields)
    return rows.select((F.substring(line, 1, most) if most else line).alias("value"))


def append_log(rows: DataFrame, path: str, *columns: str, most: int = 1000) -> None:
    log_lines(rows, *columns, most=most).write.mode("append").text(path)
