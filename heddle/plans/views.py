"""Views that give the driver's tables the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.profile import Profile

#: All queries look at the tables as of this second: 2024-01-31, after the last event.
AS_OF = 1706659200.0
PROFILE = Profile(role_keywords=("ing", "tion"), exclude_keywords=("senior", "sr", "heit", "ère"), location_pref=("remote", "global", "china", "germany", "asia"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as state rows: the title is the whole text, the source is the board."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        n.alias("id"), F.col("lang").alias("company"), F.col("source").alias("ats"), n.cast("string").alias("job_id"), F.col("text").alias("title"), F.col("lang").alias("location"),
        (F.lit(AS_OF) - (n * 7919) % 604800).cast("double").alias("first_seen"), (F.lit(AS_OF) - (n * 104729) % 86400).cast("double").alias("last_seen"),
        F.contains(F.lower("text"), F.lit("ing")).cast("int").alias("matched"), (n % 11 == 0).cast("int").alias("applied"), (n % 17 == 0).cast("int").alias("hidden"), (n % 7 == 0).cast("int").alias("closed"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nation and region as places of work."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    both = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.element_at(F.array(*map(F.lit, ("remote", "hybrid", "onsite", "", "full time"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return both.select("c_custkey", F.col("c_mktsegment").alias("title"), F.when(F.col("c_custkey") % 13 == 0, "").otherwise(F.concat_ws(", ", "n_name", "r_name")).alias("location"), kind.alias("work_type"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of a job (user) on a board (event type) at a tick (day)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("board"), F.col("user_id").alias("job"), F.to_date("ts").alias("tick"), "event_id", "value")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, suppliers and customers as three lists of raw company entries, in this order."""
    p, s, c = (table(spark, sf_dir, t) for t in ("part", "supplier", "customer"))
    board = F.element_at(F.array(F.lit("https://boards.greenhouse.io/"), F.lit("https://jobs.lever.co/"), F.lit("https://example.com/careers/"), F.lit("")), (F.col("k") % 4 + 1).cast("int"))
    label = F.element_at(F.array(*map(F.lit, ("greenhouse", "lever", "unknown", "custom", ""))), (F.col("k") % 5 + 1).cast("int"))

    def entry(df: DataFrame, level: int, key: str, name, source: str) -> DataFrame:
        base = df.select(F.col(key).alias("k"), name.alias("n"))
        slug = F.regexp_replace(F.lower(F.col("n")), "[^a-z0-9]", "")
        url = F.when(F.col("k") % 4 == 3, "").otherwise(F.concat(board, slug))
        site = F.when(F.col("k") % 3 == 0, F.concat(F.lit("https://www."), slug, F.lit(".com"))).otherwise("")
        return base.select((F.col("k") + level * 10_000_000).alias("seq"), F.col("n").alias("company_name"), url.alias("career_page_url"), site.alias("website"), F.when(F.col("k") % 6 == 0, slug).otherwise("").alias("domain_hint"), label.alias("ats_type"), F.lit(source).alias("source_platform"))

    word = F.substring_index("p_name", " ", 1)
    parts = entry(p, 0, "p_partkey", F.concat(word, F.lit(" "), F.col("p_brand")), "parts")
    return parts.unionByName(entry(s, 1, "s_suppkey", F.col("s_name"), "suppliers")).unionByName(entry(c, 2, "c_custkey", F.concat(F.lit("Brand#"), (F.col("c_custkey") % 50).cast("string"), F.lit(" (Inc)")), "customers"))
