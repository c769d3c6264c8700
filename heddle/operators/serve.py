"""Serving queries and roll-ups over the state table of postings. ``as_of`` is seconds since the epoch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.dates import utc_date
from heddle.functions.names import text


@dataclass(frozen=True)
class JobsFilter:
    """What a listing shows; None means any."""

    closed: str = "exclude"
    search: str = ""
    ats: str | None = None
    matched: bool | None = None
    applied: bool | None = None
    recent_seconds: float | None = None
    sort: str = "recent"
    limit: int = 200
    offset: int = 0


def filtered(jobs: DataFrame, want: JobsFilter, as_of: float) -> DataFrame:
    """Hidden rows never show. The search is a literal substring of company, title or location, case aside."""
    out = jobs.where("hidden = 0")
    if want.closed in ("exclude", "only"):
        out = out.where(F.col("closed") == (1 if want.closed == "only" else 0))
    if want.search:
        q = F.lit(want.search.lower())
        out = out.where(F.contains(F.lower(text(F.col("company"))), q) | F.contains(F.lower(text(F.col("title"))), q) | F.contains(F.lower(text(F.col("location"))), q))
    if want.ats:
        out = out.where(F.col("ats") == want.ats)
    for name in ("matched", "applied"):
        if (flag := getattr(want, name)) is not None:
            out = out.where(F.col(name) == int(flag))
    if want.recent_seconds:
        out = out.where(F.col("first_seen") >= as_of - want.recent_seconds)
    return out


def sort_columns(mode: str, tie: str = "id") -> list[Column]:
    """By a mode's columns and then the id; an unknown mode is ``recent``."""
    recent = F.col("first_seen").desc()
    return {"company": [F.col("company").asc(), recent], "matched": [F.col("matched").desc(), recent]}.get(mode, [recent]) + [F.col(tie).asc()]


def list_jobs(jobs: DataFrame, want: JobsFilter, as_of: float, most: int = 1000) -> DataFrame:
    """A page: at most ``most`` rows from an offset."""
    page = filtered(jobs, want, as_of).orderBy(*sort_columns(want.sort))
    return page.offset(max(0, want.offset)).limit(max(1, min(most, want.limit)))


def count_jobs(jobs: DataFrame, want: JobsFilter, as_of: float) -> DataFrame:
    return filtered(jobs, want, as_of).agg(F.count(F.lit(1)).alias("total"))


def tiles(jobs: DataFrame, as_of: float) -> DataFrame:
    """The six counts of the dashboard in one pass."""
    open_, day = F.col("closed") == 0, F.col("first_seen") >= as_of - 86400
    return jobs.agg(
        F.count_if(open_).alias("total"),
        F.count_if(open_ & (F.col("matched") == 1)).alias("matched"),
        F.count_if(open_ & (F.col("applied") == 1)).alias("applied"),
        F.count_if(F.col("closed") == 1).alias("closed"),
        F.count_if(open_ & day).alias("last_24h"),
        F.count_if(open_ & day & (F.col("matched") == 1)).alias("matched_24h"),
    )


def open_by_source(jobs: DataFrame) -> DataFrame:
    return jobs.where("closed = 0").groupBy("ats").agg(F.count(F.lit(1)).alias("n"))


def as_map(counts: DataFrame, key: str, value: str) -> DataFrame:
    """A grouped count as one map; its size is the number of groups."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("counts"))


def ledger_counts(ledger: DataFrame) -> DataFrame:
    """Rows by ``mode:status``."""
    return ledger.groupBy(F.concat_ws(":", "mode", "status").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def runs_by_day(runs: DataFrame) -> DataFrame:
    """Finished runs by UTC day: how many, what they found, the last start."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    done = runs.where(F.col("status").isin("success", "failed"))
    return done.groupBy(utc_date(F.col("started_at")).alias("day")).agg(F.count(F.lit(1)).alias("runs"), total("jobs_new"), total("jobs_matched"), total("companies_done"), F.max("started_at").alias("last_started"))


def latest(df: DataFrame, by: str, n: int, tie: str = "id", most: int = 1000) -> DataFrame:
    """The last n rows by a column."""
    return df.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(max(1, min(most, n)))


def latest_days(daily: DataFrame, days: int = 14) -> DataFrame:
    """The last 1 to 120 days of the daily counters, newest first."""
    return latest(daily, "date", days, tie="date", most=120)


def latest_ledger(ledger: DataFrame, n: int = 200, tie: str = "job_id") -> DataFrame:
    """The last 1 to 1000 rows of the ledger, newest first."""
    return latest(ledger, "applied_at", n, tie=tie)


def seen_by_source(postings: DataFrame) -> DataFrame:
    """How many postings a pass saw on each source, most first; closed and hidden ones count too."""
    return postings.groupBy("ats").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ats")


def snapshot(jobs: DataFrame, cap: int = 0) -> DataFrame:
    """All rows, or the first ``cap``, by when they were last seen."""
    out = jobs.orderBy(F.col("last_seen").desc(), F.col("id").asc())
    return out.limit(cap) if cap else out


def sources(jobs: DataFrame) -> DataFrame:
    return jobs.where("ats is not null").select("ats").distinct().orderBy("ats")


def by_id(jobs: DataFrame, job_id: int) -> DataFrame:
    return jobs.where(F.col("id") == job_id).limit(1)


def company_stats(companies: DataFrame, automatable: tuple[str, ...] | None = None) -> DataFrame:
    """Companies by source, and how many can be read by machine: by a list of boards, or where they have a token."""
    readable = F.col("ats_type").isin(*automatable) if automatable else text(F.col("board_token")) != ""
    return companies.groupBy("ats_type").agg(F.count(F.lit(1)).alias("companies"), F.count_if(readable).alias("automatable"))


def grouped_listing(postings: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows by (company_seq, job_seq), the limit coming before the sort: newest first, unknown dates
    last, each with the place of its company's first row."""
    first = postings.orderBy("company_seq", "job_seq").limit(limit)
    groups = first.groupBy("company").agg(F.min("company_seq").alias("group_seq"))
    return first.join(groups, "company").orderBy(F.col("posted_ts").desc_nulls_last(), "company_seq", "job_seq")


def status(closed: Column, applied: Column, matched: Column) -> Column:
    """What a row is shown as; the first that holds."""
    return F.when(closed == 1, "closed").when(applied == 1, "applied").when(matched == 1, "matched").otherwise("other")
