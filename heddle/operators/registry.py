"""The registry of companies: upserts with sticky fields, clean-up, and its numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.names import is_junk_slug, known, text
from heddle.functions.urls import any_of, registry_slug
from heddle.operators.merge import first_per_key

#: Hosts that collect other companies' postings.
AGGREGATORS = ("himalayas.app", "wellfound.com", "angel.co", "otta.com")
SLUG_BOARDS = ("greenhouse", "lever", "ashby", "workable", "smartrecruiters", "rippling", "teamtailor", "personio", "breezyhr", "bamboohr", "pinpoint")


def registry_upsert(registry: DataFrame, batch: DataFrame, recheck: bool = True, order: str = "seq") -> DataFrame:
    """The registry after a batch, with ``is_new`` and ``became_reliable``.

    Both hold norm_key, name, website, career_page_url, ats_type, source, http_status, reliable (0/1), first_seen; the
    batch also an order. Name and status are the last ones; website and URL the last that are not blank; the source
    type the last that is not ``unknown``; reliable only rises; source and first_seen stay. Without ``recheck`` a key
    that was reliable before the batch takes name (unless blank), website and type only.
    """
    at = F.col(order)

    def last_known(c: str, blank: str) -> Column:
        return F.max_by(c, F.when(text(F.col(c)) != blank, at)).alias(f"n_{c}")

    new = batch.groupBy("norm_key").agg(
        F.max_by("name", at).alias("n_name"), last_known("name", "").alias("n_known_name"), last_known("website", ""), last_known("career_page_url", ""), last_known("ats_type", "unknown"),
        F.max_by("http_status", at).alias("n_http_status"), F.max("reliable").alias("n_reliable"), F.min_by("source", at).alias("n_source"), F.min_by("first_seen", at).alias("n_first_seen"), F.lit(True).alias("_new"),
    )
    both = registry.withColumn("_old", F.lit(True)).join(new, "norm_key", "full_outer")
    here, was = F.coalesce("_new", F.lit(False)), F.coalesce("_old", F.lit(False))
    light = F.lit(not recheck) & was & (F.coalesce("reliable", F.lit(0)) == 1)
    full = here & ~light
    return both.select(
        "norm_key",
        F.when(full, F.col("n_name")).when(here, F.coalesce("n_known_name", "name")).otherwise(F.col("name")).alias("name"),
        F.coalesce("n_website", "website", F.lit("")).alias("website"),
        F.when(light, F.col("career_page_url")).otherwise(F.coalesce("n_career_page_url", "career_page_url", F.lit(""))).alias("career_page_url"),
        F.coalesce("n_ats_type", "ats_type", F.lit("unknown")).alias("ats_type"),
        F.coalesce("source", "n_source").alias("source"),
        F.when(full, F.col("n_http_status")).otherwise(F.col("http_status")).alias("http_status"),
        F.greatest(F.coalesce("reliable", F.lit(0)), F.when(full, F.coalesce("n_reliable", F.lit(0))).otherwise(F.lit(0))).alias("reliable"),
        F.coalesce("first_seen", "n_first_seen").alias("first_seen"),
        (~was).alias("is_new"),
        (full & (F.coalesce("n_reliable", F.lit(0)) == 1) & (F.coalesce("reliable", F.lit(0)) == 0)).alias("became_reliable"),
    )


def without_aggregators(registry: DataFrame, hosts: tuple[str, ...] = AGGREGATORS) -> DataFrame:
    return registry.where(~any_of(F.lower(text(F.col("career_page_url"))), hosts))


def without_junk(registry: DataFrame) -> DataFrame:
    slug = registry_slug(F.col("ats_type"), F.col("career_page_url"))
    return registry.where(~(F.col("ats_type").isin(*SLUG_BOARDS) & F.coalesce(is_junk_slug(slug) & slug.isNotNull(), F.lit(False))))


def one_per_board(registry: DataFrame) -> DataFrame:
    """Of the rows of a board's slug one stays: the first whose name is not the slug itself, else the first, by
    (first_seen, norm_key). Rows without a slug stay."""
    slugged = registry.withColumn("_slug", registry_slug(F.col("ats_type"), F.col("career_page_url")))
    plain = F.regexp_replace(F.lower(text(F.col("name"))), "[^a-z0-9]", "") == F.regexp_replace(F.lower(F.col("_slug")), "[^a-z0-9]", "")
    ranked = slugged.where("_slug is not null").withColumn("_plain", plain)
    kept = first_per_key(ranked, ["ats_type", "_slug"], ["_plain", "first_seen", "norm_key"])
    return slugged.where("_slug is null").drop("_slug").unionByName(kept.drop("_slug", "_plain"))


def reliable_boards(registry: DataFrame, board: str) -> DataFrame:
    """Reliable rows of a source that are not dead and have a URL; an unknown status is left out."""
    return registry.where((F.col("reliable") == 1) & (F.col("ats_type") == board) & ~F.startswith("http_status", F.lit("dead")) & (text(F.col("career_page_url")) != ""))


def export(registry: DataFrame) -> DataFrame:
    return registry.where((F.col("reliable") == 1) & known(F.col("career_page_url")).isNotNull()).orderBy("name", "norm_key")


def progress(registry: DataFrame, goal: int) -> DataFrame:
    """How many companies, how many reliable, and how far from the goal."""
    n = F.count_if(F.col("reliable") == 1)
    return registry.agg(F.count(F.lit(1)).alias("total"), n.alias("reliable"), F.round(100 * n / goal, 1).alias("percent"), F.greatest(F.lit(goal) - n, F.lit(0)).alias("gap"))
