"""The state of postings as keyed state of a stream: each batch costs the boards that it brings, not all that is known.

Events are rows of one stream: postings of a tick, a mark for each board (company, source) that a tick read whole, ledger
keys, and flags that a user raised. Keys are (company, source, lane); a board's postings are dealt to ``lanes`` by a hash
of their id, so that a board with most of the rows is the work of several tasks, and its mark goes to every lane.

Each key keeps a map from posting id to row in Spark's state store (RocksDB, so the state may exceed memory), the ledger
keys that are not postings yet, and the time of its last tick. A tick is folded in as :func:`heddle.operators.state.tick`
does it. What comes out are changes: of every posting that a batch touched the row after it and, as ``was_``, the flags
before it, from which a sink can upsert stored state and move counts (:mod:`heddle.operators.store`, ``deltas``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heddle.operators.merge import last_per_key
from heddle.operators.state import COMPLETE, FRESH, GRACE, KEY, STATE

EVENT = "kind string, company string, ats string, lane int, job_id string, title string, location string, work_type string, url string, posted_at string, matched int, seq long, now double"
_FLAGS = ("matched", "applied", "hidden", "closed")
CHANGE = f"{STATE}, is_new boolean, {', '.join(f'was_{c} int' for c in _FLAGS)}, was_first_seen double"
#: The kinds of events.
POSTING, BOARD, LEDGER, APPLIED, HIDDEN = "posting", "board", "ledger", "applied", "hidden"
_NAMES = [c.split()[0] for c in STATE.split(", ")]
_VALUE = ", ".join(c for c in STATE.split(", ") if c.split()[0] not in KEY)
_AT = {c: i for i, c in enumerate(n for n in _NAMES if n not in KEY)}


def lane(job_id: str | F.Column, lanes: int):
    return F.pmod(F.xxhash64(job_id), F.lit(lanes)).cast("int")


def tick_events(fresh: DataFrame, lanes: int = 8, complete: tuple[str, ...] = COMPLETE) -> DataFrame:
    """Events of postings (key, FRESH, seq, now): the last of a key in a tick, and a mark of each whole board for each lane."""
    last = last_per_key(fresh, [*KEY, "now"], ["seq"]).select(F.lit(POSTING).alias("kind"), "company", "ats", lane("job_id", lanes).alias("lane"), "job_id", *FRESH, F.col("seq").cast("long").alias("seq"), "now")
    boards = fresh.where(F.col("ats").isin(*complete)).select("company", "ats", "now").distinct().withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return last.unionByName(boards.withColumn("kind", F.lit(BOARD)), allowMissingColumns=True).select(*(x.split()[0] for x in EVENT.split(", ")))


def flag_events(keys: DataFrame, kind: str, now: float, lanes: int = 8) -> DataFrame:
    """Events of keys: ``ledger`` (counts from a posting's next sighting on), ``applied`` or ``hidden`` (count at once)."""
    rows = keys.select(*KEY).distinct().withColumns({"kind": F.lit(kind), "lane": lane("job_id", lanes), "now": F.lit(float(now))})
    return rows.sparkSession.createDataFrame([], EVENT).unionByName(rows, allowMissingColumns=True)


class Postings(StatefulProcessor):
    """Folds the events of a (company, source, lane). Ticks older than the key's last one are passed over; a tick whose
    rows come in two batches counts once, with its later rows as sightings alone."""

    def __init__(self, grace: int = GRACE):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("postings", "job_id string", _VALUE)
        self.known = handle.getMapState("ledger", "job_id string", "there int")
        self.last = handle.getValueState("last", "now double, missed int")

    def handleInitialState(self, key: Any, initial: pd.DataFrame, timer_values: Any) -> None:
        for row in initial.to_dict("records"):
            self.rows.updateValue((row["job_id"],), tuple(_plain(row[c]) for c in _AT))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True)
        before = {k[0]: list(v) for k, v in self.rows.iterator()} if (events["kind"] == BOARD).any() else {}
        state: dict[str, list] = {k: list(v) for k, v in before.items()}
        whole, touched = bool(before), {}

        def row_of(job: str) -> list | None:
            if job not in state and not whole and self.rows.containsKey((job,)):
                before[job] = list(self.rows.getValue((job,)))
                state[job] = list(before[job])
            return state.get(job)

        last, missed = self.last.get() if self.last.exists() else (float("-inf"), 0)
        for now, batch in events.sort_values("now", kind="stable").groupby("now", sort=True):
            for kind, job in zip(batch["kind"], batch["job_id"], strict=True):
                if kind == LEDGER:
                    self.known.updateValue((job,), (1,))
                elif kind in (APPLIED, HIDDEN) and (row := row_of(job)) is not None and not row[_AT[kind]]:
                    row[_AT[kind]] = 1
                    touched[job] = None
            seen = batch[batch["kind"] == POSTING]
            board = (batch["kind"] == BOARD).any()
            if not (len(seen) or board) or now < last:
                continue
            here = set()
            for r in seen.sort_values("seq", kind="stable").to_dict("records"):
                here.add(r["job_id"])
                self._sighted(row_of(r["job_id"]), r, now, state)
            touched.update(dict.fromkeys(here))
            # A board whose tick came already has had its absences counted.
            if board and (now > last or not missed):
                touched.update(dict.fromkeys(self._absent(state, here, now)))
            missed = int(board or (now == last and bool(missed)))
            last = now
        if last > float("-inf"):
            self.last.update((float(last), missed))
        out = [job for job in touched if state.get(job) != before.get(job) or job not in before]
        for job in out:
            self.rows.updateValue((job,), tuple(state[job]))
        if out:
            yield self._changes(key, out, state, before)

    def _sighted(self, row: list | None, r: dict, now: float, state: dict[str, list]) -> None:
        job, new = r["job_id"], row is None
        if new:
            row = state[job] = [None] * len(_AT)
            row[_AT["first_seen"]], row[_AT["applied"]], row[_AT["hidden"]] = float(now), 0, 0
        for c in FRESH:
            row[_AT[c]] = _plain(r[c])
        row[_AT["matched"]] = None if row[_AT["matched"]] is None else int(row[_AT["matched"]])
        row[_AT["last_seen"]] = row[_AT["last_check"]] = float(now)
        row[_AT["closed"]], row[_AT["closed_at"]], row[_AT["miss_count"]] = 0, None, 0
        if not row[_AT["applied"]] and self.known.exists() and self.known.containsKey((job,)):
            row[_AT["applied"]] = 1

    def _absent(self, state: dict[str, list], here: set[str], now: float) -> Iterable[str]:
        for job, row in state.items():
            if job in here or row[_AT["applied"]]:
                continue
            row[_AT["miss_count"]] += 1
            row[_AT["last_check"]] = float(now)
            if row[_AT["miss_count"]] >= self.grace and not row[_AT["closed"]]:
                row[_AT["closed"]], row[_AT["closed_at"]] = 1, float(now)
            yield job

    def _changes(self, key: Any, jobs: list[str], state: dict, before: dict) -> pd.DataFrame:
        told = {"company": [key[0]] * len(jobs), "ats": [key[1]] * len(jobs), "job_id": jobs}
        told |= {c: [state[j][i] for j in jobs] for c, i in _AT.items()}
        told["is_new"] = [j not in before for j in jobs]
        for c in (*_FLAGS, "first_seen"):
            told[f"was_{c}"] = [before[j][_AT[c]] if j in before else None for j in jobs]
        ints = {c: "Int32" for c in ("matched", "applied", "hidden", "closed", "miss_count", *(f"was_{c}" for c in _FLAGS))}
        return pd.DataFrame(told).astype(ints)

    def close(self) -> None:
        pass


def _plain(value: Any) -> Any:
    """A cell as plain Python; what pandas calls missing is None."""
    if value is None or value is pd.NA or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def use_rocksdb(spark: SparkSession) -> None:
    """State that may exceed memory; a session's choice, so the caller's to make."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def changes(events: DataFrame, grace: int = GRACE, initial: DataFrame | None = None, lanes: int = 8) -> DataFrame:
    """The changes of a stream of events. ``initial`` is state to start from (STATE), used by the first batch of a new query."""
    grouped = None if initial is None else initial.withColumn("lane", lane("job_id", lanes)).groupBy("company", "ats", "lane")
    return events.groupBy("company", "ats", "lane").transformWithStateInPandas(Postings(grace), CHANGE, outputMode="Update", timeMode="None", initialState=grouped)
