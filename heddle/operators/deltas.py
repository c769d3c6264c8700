"""Counts that are kept by signed changes instead of being counted again.

A changed row counts 1 where it now belongs and -1 where it belonged before. The stored counts are cells: one for each
combination of values that the wanted numbers ask for, so that any of these is a sum over few cells. Cells of zero go.
The dashboard's cells keep when a posting was first seen, which is a tick's time, so its numbers of the last day are exact
for every ``as_of``; :func:`settle` joins the cells of ticks that no question asks for any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.store import BucketStore

#: The cells of postings, of the ledger and of the registry.
POSTING_CELL = ("ats", "first_seen", "matched", "applied", "hidden", "closed")
POSTING_CELLS = "ats string, first_seen double, matched int, applied int, hidden int, closed int, n long"
LEDGER_CELL, LEDGER_CELLS = ("mode", "status"), "mode string, status string, n long"
REGISTRY_CELL, REGISTRY_CELLS = ("reliable",), "reliable int, n long"


def signed(changes: DataFrame, cell: Sequence[str], after: dict[str, Column], before: dict[str, Column], existed: Column, exists: Column | None = None) -> DataFrame:
    """``cell`` columns and n, the sum of signs; cells that do not change are left out.

    ``after`` and ``before`` give the cell's columns of a row now and before; ``existed`` and ``exists`` say whether it was
    and is there at all.
    """
    here = F.struct(*(after[c].alias(c) for c in cell), F.lit(1).cast("long").alias("n"))
    there = F.struct(*(before[c].alias(c) for c in cell), F.lit(-1).cast("long").alias("n"))
    both = F.array(F.when(F.lit(True) if exists is None else exists, here), F.when(existed, there))
    each = changes.select(F.explode(both).alias("x")).where("x is not null").select("x.*")
    return each.groupBy(*cell).agg(F.sum("n").alias("n")).where("n <> 0")


def posting_deltas(changes: DataFrame) -> DataFrame:
    """From the changes of :mod:`heddle.streaming.keyed`."""
    after = {c: F.col(c) for c in POSTING_CELL}
    before = {"ats": F.col("ats")} | {c: F.col(f"was_{c}") for c in POSTING_CELL if c != "ats"}
    return signed(changes, POSTING_CELL, after, before, ~F.col("is_new"))


def state_changes(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The same for two states of postings by ``key``: rows that differ in a cell's columns, came, or went (``gone``)."""
    was = old.select(*key, *(F.col(c).alias(f"was_{c}") for c in POSTING_CELL if c not in key), F.lit(True).alias("_was"))
    both = new.select(*key, *(c for c in POSTING_CELL if c not in key), F.lit(True).alias("_is")).join(was, list(key), "full_outer")
    differs = F.col("_was").isNull() | F.col("_is").isNull() | ~F.struct(*(c for c in POSTING_CELL if c not in key)).eqNullSafe(F.struct(*(F.col(f"was_{c}").alias(c) for c in POSTING_CELL if c not in key)))
    return both.where(differs).withColumns({"is_new": F.col("_was").isNull(), "gone": F.col("_is").isNull()}).drop("_was", "_is")


def ledger_deltas(added: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """Ledger rows that came, and those that they took the place of."""
    rows = added.select(*LEDGER_CELL, F.lit(1).alias("sign"))
    if replaced is not None:
        rows = rows.unionByName(replaced.select(*LEDGER_CELL, F.lit(-1).alias("sign")))
    return rows.groupBy(*LEDGER_CELL).agg(F.sum("sign").alias("n")).where("n <> 0")


def registry_deltas(upserted: DataFrame) -> DataFrame:
    """From the rows of ``registry_upsert``, of which those that a batch did not touch change nothing."""
    fell = F.when(F.col("became_reliable"), 0).otherwise(F.col("reliable"))
    return signed(upserted.where("is_new or became_reliable"), REGISTRY_CELL, {"reliable": F.col("reliable")}, {"reliable": fell}, ~F.col("is_new"))


def add(cells: DataFrame, deltas: DataFrame) -> DataFrame:
    """Stored cells with deltas; as a merge of a store whose ``by`` are cell columns it touches only the deltas' buckets."""
    cell = [c for c in cells.columns if c != "n"]
    return cells.unionByName(deltas.select(*cells.columns)).groupBy(*cell).agg(F.sum("n").alias("n")).where("n <> 0")


def settle(cells: DataFrame, before: float) -> DataFrame:
    """Posting cells first seen before a time, as one for each combination of the rest; their time is then unknown (null)."""
    cell = [c for c in cells.columns if c != "n"]
    early = F.when(F.col("first_seen") >= before, F.col("first_seen"))
    return cells.withColumn("first_seen", early).groupBy(*cell).agg(F.sum("n").alias("n")).where("n <> 0")


def tiles(cells: DataFrame, as_of: float) -> DataFrame:
    """The dashboard's six counts; equal to :func:`heddle.operators.serve.tiles` of the rows that the cells count."""
    open_, day = F.col("closed") == 0, F.coalesce(F.col("first_seen") >= as_of - 86400, F.lit(False))
    n = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
    return cells.agg(n(open_, "total"), n(open_ & (F.col("matched") == 1), "matched"), n(open_ & (F.col("applied") == 1), "applied"), n(F.col("closed") == 1, "closed"), n(open_ & day, "last_24h"), n(open_ & day & (F.col("matched") == 1), "matched_24h"))


def open_by_source(cells: DataFrame) -> DataFrame:
    return cells.where("closed = 0").groupBy("ats").agg(F.sum("n").alias("n"))


def ledger_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy(F.concat_ws(":", "mode", "status").alias("key")).agg(F.sum("n").alias("n"))


def progress(cells: DataFrame, goal: int) -> DataFrame:
    """Equal to :func:`heddle.operators.registry.progress`."""
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    n = some(F.col("reliable") == 1)
    return cells.agg(some(F.lit(True)).alias("total"), n.alias("reliable"), F.round(100 * n / goal, 1).alias("percent"), F.greatest(F.lit(goal) - n, F.lit(0)).alias("gap"))


def recount(jobs: DataFrame) -> DataFrame:
    """Posting cells counted from rows: what the deltas of any history must come to."""
    return jobs.groupBy(*POSTING_CELL).agg(F.count(F.lit(1)).alias("n"))


def sink(state: BucketStore, cells: BucketStore, key: Sequence[str]):
    """A ``foreachBatch`` function: the changes of a batch into stored state and counts, each once however often it runs."""
    from heddle.operators.store import upsert

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            state.apply(batch.select(*(c for c in batch.columns if c == "is_new" or not c.startswith("was_"))), upsert(*key), number)
            cells.apply(posting_deltas(batch), add, number)
        finally:
            batch.unpersist()

    return run


