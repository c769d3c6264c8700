"""The keyed state of postings: upsert, absence, flags. One tick is one batch; ``tick`` folds it into the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.merge import first_per_key, last_per_key

KEY = ["company", "ats", "job_id"]
STATE = (
    "company string, ats string, job_id string, title string, location string, work_type string, url string, posted_at string, "
    "first_seen double, last_seen double, last_check double, matched int, applied int, hidden int, closed int, closed_at double, miss_count int"
)
FRESH = ("title", "location", "work_type", "url", "posted_at", "matched")
#: Sources whose boards are read whole, so that absence means something.
COMPLETE = ("greenhouse", "lever", "ashby", "smartrecruiters", "personio", "rippling", "teamtailor")
GRACE = 2


def applied_flag(postings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Postings with ``applied``: 1 where the ledger has any row of their key."""
    known = ledger.select(*KEY).distinct().withColumn("_hit", F.lit(1))
    return postings.join(known, KEY, "left").withColumn("applied", F.coalesce("_hit", F.lit(0))).drop("_hit")


def raise_flag(state: DataFrame, keys: DataFrame, flag: str) -> DataFrame:
    """A flag set where a key is listed; it never falls. The rows that changed have ``touched``."""
    known = keys.select(*KEY).distinct().withColumn("_hit", F.lit(1))
    raised = F.greatest(F.col(flag), F.coalesce("_hit", F.lit(0)))
    return state.join(known, KEY, "left").withColumn("touched", raised > F.col(flag)).withColumn(flag, raised).drop("_hit")


def mark_applied(ledger: DataFrame, keys: DataFrame, mode: str = "manual", status: str = "submitted") -> DataFrame:
    """The ledger with a row for each key that had none."""
    new = keys.select(*KEY).distinct().join(ledger.select(*KEY), KEY, "left_anti").withColumns({"mode": F.lit(mode), "status": F.lit(status)})
    return ledger.unionByName(new, allowMissingColumns=True)


def tick(state: DataFrame, fresh: DataFrame, ledger: DataFrame, now: float, grace: int = GRACE, order: str = "seq", complete: tuple[str, ...] = COMPLETE) -> DataFrame:
    """The state after one tick, with ``is_new``.

    ``fresh`` holds the tick's postings (key, FRESH columns and an order among repeats, of which the last counts).
    New keys start; known ones take the fresh values, reopen and lose their misses; applied only rises; first_seen and
    hidden stay. On boards (company, source) of complete sources with any fresh row, unapplied rows that are absent
    miss once more and close after ``grace`` misses. Other boards, failed or empty, are left as they are.
    """
    seen = applied_flag(last_per_key(fresh.select(*KEY, *FRESH, order), KEY, [order]).drop(order), ledger).withColumnsRenamed({c: f"f_{c}" for c in (*FRESH, "applied")}).withColumn("_seen", F.lit(True))
    boards = fresh.where(F.col("ats").isin(*complete)).select("company", "ats").distinct().withColumn("_board", F.lit(True))
    both = state.withColumn("_known", F.lit(True)).join(seen, KEY, "full_outer").join(boards, ["company", "ats"], "left")
    here, known = F.coalesce("_seen", F.lit(False)), F.coalesce("_known", F.lit(False))
    absent = ~here & F.coalesce("_board", F.lit(False)) & (F.col("applied") == 0)
    miss = F.when(here, F.lit(0)).when(absent, F.col("miss_count") + 1).otherwise(F.col("miss_count"))
    closing = absent & (F.col("closed") == 0) & (F.col("miss_count") + 1 >= grace)
    stamp = F.lit(float(now))
    return both.select(
        *KEY,
        *(F.when(here, F.col(f"f_{c}")).otherwise(F.col(c)).alias(c) for c in FRESH if c != "matched"),
        F.coalesce("first_seen", stamp).alias("first_seen"),
        F.when(here, stamp).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(here | absent, stamp).otherwise(F.col("last_check")).alias("last_check"),
        F.when(here, F.col("f_matched")).otherwise(F.col("matched")).cast("int").alias("matched"),
        F.greatest(F.coalesce("applied", F.lit(0)), F.coalesce("f_applied", F.lit(0))).alias("applied"),
        F.coalesce("hidden", F.lit(0)).alias("hidden"),
        F.when(here, F.lit(0)).when(closing, F.lit(1)).otherwise(F.col("closed")).alias("closed"),
        F.when(closing, stamp).when(~here, F.col("closed_at")).alias("closed_at"),
        miss.alias("miss_count"),
        (~known).alias("is_new"),
    )


def insert_absent(state: DataFrame, rows: DataFrame, order: list) -> DataFrame:
    """Rows of a snapshot whose key is not there yet, the first of each key."""
    return state.unionByName(first_per_key(rows.join(state.select(*KEY), KEY, "left_anti"), KEY, order).select(*state.columns))


def purge(state: DataFrame, boards: tuple[str, ...]) -> DataFrame:
    """Only rows of the listed sources; an empty list changes nothing."""
    return state.where(F.col("ats").isin(*boards)) if boards else state


def final_state(observations: DataFrame, applied: DataFrame, grace: int = GRACE) -> DataFrame:
    """The state after many ticks at once, from ``observations(board, job, tick)`` of complete sources.

    ``applied(board, job)`` is fixed. A board's ticks are those it was seen in at all, numbered from 1. A row's
    misses are the board's ticks after its last one, none where applied; it closes at the grace-th of them.
    """
    obs = observations.select("board", "job", "tick").distinct()
    ticks = obs.select("board", "tick").distinct().withColumn("n", F.row_number().over(Window.partitionBy("board").orderBy("tick")))
    last = ticks.groupBy("board").agg(F.max("n").alias("ticks"))
    keys = obs.join(ticks, ["board", "tick"]).groupBy("board", "job").agg(F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"), F.max("n").alias("last_n"))
    keys = keys.join(last, "board").join(applied.select("board", "job").distinct().withColumn("hit", F.lit(1)), ["board", "job"], "left")
    keys = keys.withColumn("applied", F.coalesce("hit", F.lit(0))).withColumn("miss_count", F.when(F.col("applied") == 1, 0).otherwise(F.col("ticks") - F.col("last_n")))
    keys = keys.withColumn("closed", (F.col("miss_count") >= grace).cast("int")).withColumn("close_n", F.when(F.col("closed") == 1, F.col("last_n") + grace))
    at = ticks.select("board", F.col("n").alias("close_n"), F.col("tick").alias("closed_tick"))
    return keys.join(at, ["board", "close_n"], "left").select("board", "job", "first_tick", "last_tick", "applied", "miss_count", "closed", "closed_tick")
