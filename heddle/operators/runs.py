"""Runs of the discovery task and the state that outlives them: lifecycle, daily counters, flags, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.dates import utc_date
from heddle.functions.names import known, text
from heddle.operators.merge import append_absent, capped_list, last_per_key, overwrite, sample_per_key
from heddle.operators.state import KEY

KEPT_SCANS, KEPT_NEW = 30, 200
STANDARD = ("greenhouse", "lever", "ashby")


def current_runs(events: DataFrame) -> DataFrame:
    """Runs as they stand: events are appended (id, seq, status and counters), the last of an id counts."""
    return last_per_key(events, ["id"], ["seq"])


def daily_counters(runs: DataFrame) -> DataFrame:
    """What runs added up to on each UTC day; failed ones add nothing. Derived, never stored and changed."""
    done = runs.where("status = 'success'")
    add = lambda c, name: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(name)
    return done.groupBy(utc_date(F.col("started_at")).alias("date")).agg(F.count(F.lit(1)).alias("runs"), add("jobs_new", "jobs_new"), add("jobs_matched", "jobs_matched"), add("companies_done", "companies_enumerated"))


def recent_scans(scans: DataFrame, new_jobs: DataFrame, n: int = KEPT_SCANS, cap: int = KEPT_NEW) -> DataFrame:
    """The last n scans, each with its first ``cap`` new jobs and how many there were."""
    last = scans.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)
    listed = capped_list(new_jobs.join(F.broadcast(last.select("run_id")), "run_id", "left_semi"), ["run_id"], "job_id", ["seq"], cap)
    return last.join(listed, "run_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def saved_applied(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Applied postings kept outside the state: a new entry of a key replaces the old one."""
    return overwrite(saved, new, KEY, ["applied_at"])


def saved_hidden(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Hidden postings kept outside the state: what is there stays."""
    return append_absent(saved, new, KEY, ["hidden_at"])


def flat_seed(rows: DataFrame, now: float) -> DataFrame:
    """State rows from a flat list (url, company, ats, title, location, loc_class): no row without a URL, which is also
    the job id; unknown company and source; matched where the place was accepted."""
    other = lambda c: F.coalesce(known(F.col(c)), F.lit("unknown"))
    stamp = F.lit(float(now))
    return rows.where(text(F.col("url")) != "").select(
        other("company").alias("company"), other("ats").alias("ats"), F.col("url").alias("job_id"), text(F.col("title")).alias("title"), text(F.col("location")).alias("location"), F.lit("").alias("work_type"), "url", F.lit("").alias("posted_at"),
        stamp.alias("first_seen"), stamp.alias("last_seen"), stamp.alias("last_check"), (F.coalesce(F.col("loc_class"), F.lit("")) == "accept").cast("int").alias("matched"), F.lit(0).alias("applied"), F.lit(0).alias("hidden"), F.lit(0).alias("closed"), F.lit(None).cast("double").alias("closed_at"), F.lit(0).alias("miss_count"),
    )


def registry_seed(registry: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies of the list that the registry does not have yet, as unchecked rows of the source ``seed``."""
    rows = companies.select("norm_key", F.col("company_name").alias("name"), text(F.col("website")).alias("website"), text(F.col("career_page_url")).alias("career_page_url"), text(F.col("ats_type")).alias("ats_type"), F.lit("seed").alias("source"), F.lit("unknown").alias("http_status"), F.lit(0).alias("reliable"), F.lit(0.0).alias("first_seen"))
    return append_absent(registry, rows.where("norm_key <> ''"), ["norm_key"], ["name"])


def probe_targets(companies: DataFrame) -> DataFrame:
    """Boards to probe for companies whose source is a guess: the one guessed, or all three for an unknown one."""
    every = F.array(*map(F.lit, STANDARD))
    boards = F.when(F.col("ats_type").isin(*STANDARD), F.array("ats_type")).when(F.col("ats_type") == "unknown", every)
    return companies.where("ats_source = 'guess'").select("company_name", F.posexplode(boards).alias("place", "ats"))


def to_check(jobs: DataFrame, registry_boards: tuple[str, ...], n: int = 500) -> DataFrame:
    """The next n rows outside the readable boards to look at for dead links, by id."""
    return jobs.where(~F.col("ats").isin(*registry_boards)).orderBy("id").limit(n)


def board_sample(registry: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n companies of each source, the same at every run."""
    return sample_per_key(registry, ["ats_type"], "norm_key", n, seed)
