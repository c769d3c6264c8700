"""Boards as a data source, at once or as a stream of ticks, and as a step over a table of boards.

``spark.dataSource.register(BoardSource)`` and give ``boards`` as JSON or ``boards_path``, a file of a board per line; a
board is what :mod:`heddle.sources.transport` says. For boards that stand in a table use :func:`fetch`, which passes none of
them through the driver.

All boards of a host are dealt to ``lanes`` partitions, each of which asks it at a lanes-th of ``rate``, so a host with most of
the boards is asked by several tasks and still never faster than its rate. A board's pages are read inside one task.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from heddle.sources.transport import Fetcher, FetchError, http, url_of

PAGES = "company string, ats string, token string, url string, page_offset long, status int, payload string, error string, now double"
_OPTIONS = {"agent": str, "retries": int, "wait": float, "timeout": float, "rate": float, "lanes": int}


def _fetcher(options: dict) -> Fetcher:
    told = {k: kind(options[k]) for k, kind in _OPTIONS.items() if k in options}
    return Fetcher(options.get("transport") or http, **told)


def _rows(boards: list[dict], options: dict, now: float | None) -> Iterator[tuple]:
    fetcher = _fetcher(options)
    for b in boards:
        for url, at, status, payload, error in fetcher.pages(b):
            yield b["company"], b["ats"], b["token"], url, at, status, payload, error, now


class BoardPartition(InputPartition):
    def __init__(self, boards: list[dict], now: float | None):
        super().__init__(None)
        self.boards, self.now = boards, now


def _host(board: dict) -> str:
    try:
        return urlsplit(url_of(board)).netloc
    except FetchError:
        return ""


def dealt(boards: list[dict], lanes: int, most: int, now: float | None) -> list[InputPartition]:
    """At most ``most`` partitions of about as many boards each; those of a host lie in at most ``lanes`` of them."""
    by: dict[tuple[str, int], list[dict]] = {}
    for b in boards:
        by.setdefault((_host(b), crc32(json.dumps(b, sort_keys=True).encode()) % max(1, lanes)), []).append(b)
    parts: list[list[dict]] = [[] for _ in range(max(1, min(most, len(by))))]
    held = Counter(dict.fromkeys(range(len(parts)), 0))
    for _, some in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
        at = min(held, key=lambda p: (held[p], p))
        parts[at] += some
        held[at] += len(some)
    return [BoardPartition(p, now) for p in parts if p]


class BoardSource(DataSource):
    """Options: ``boards`` or ``boards_path``; ``transport``, a dotted name; ``agent``, ``retries``, ``wait``, ``timeout``, ``rate``
    (requests a second and host, 0 for no bound), ``lanes`` (partitions of a host), ``partitions`` (of a read at most).

    For streams ``every`` (seconds of a tick), ``slice`` (boards of a tick, the next ones each time; 0 for all), and ``now`` in
    place of the clock.
    """

    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return BoardReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BoardStreamReader(self.options)


class BoardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        if path := options.get("boards_path"):
            from pyarrow import fs

            source, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            with source.open_input_stream(at) as lines:
                self.boards = [json.loads(x) for x in lines.read().splitlines() if x.strip()]
        else:
            self.boards = json.loads(options.get("boards", "[]"))
        self.lanes, self.most = int(options.get("lanes", 1)), int(options.get("partitions", 200))

    def partitions(self) -> list[InputPartition]:
        now = self.options.get("now")
        return dealt(self.boards, self.lanes, self.most, float(now) if now else None) or [BoardPartition([], None)]

    def read(self, partition: BoardPartition) -> Iterator[tuple]:
        return _rows(partition.boards, self.options, partition.now)


class BoardStreamReader(DataSourceStreamReader):
    """Ticks of ``every`` seconds of the clock; the offset is the last tick's number, so a restart goes on where it stopped.

    A tick reads its slice of the boards, in rotation. Its ``now`` is the tick's own time, so a tick that is run again after
    a failure asks the boards again but carries the same time. Ticks that were missed come in one batch, each board once.
    """

    def __init__(self, options: dict):
        self.inner, self.options = BoardReader(options), dict(options)
        self.every, self.slice = float(options.get("every", 300)), int(options.get("slice", 0))

    def _tick(self) -> int:
        import time

        return int(float(self.options.get("now") or time.time()) // self.every)

    def initialOffset(self) -> dict:
        return {"tick": int(self.options.get("from_tick", self._tick() - 1))}

    def latestOffset(self) -> dict:
        return {"tick": self._tick()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last, boards = start["tick"] + 1, end["tick"], self.inner.boards
        if last < first or not boards:
            return []
        size = self.slice or len(boards)
        # Boards of many missed ticks come once, as of the last tick.
        begin, n = first * size % len(boards), min((last - first + 1) * size, len(boards))
        return dealt([boards[(begin + i) % len(boards)] for i in range(n)], self.inner.lanes, self.inner.most, last * self.every)

    def read(self, partition: BoardPartition) -> Iterator[tuple]:
        return _rows(partition.boards, self.options, partition.now)


def _fetch_batches(batches: Iterator[pa.RecordBatch], options: dict, now: float | None) -> Iterator[pa.RecordBatch]:
    fetcher = _fetcher(options)
    names = [x.split()[0] for x in PAGES.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64()]
    for batch in batches:
        for b in batch.to_pylist():
            for url, at, status, payload, error in fetcher.pages({k: v for k, v in b.items() if v is not None}):
                row = (b["company"], b["ats"], b["token"], url, at, status, payload, error, now)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)


def fetch(boards: DataFrame, now: float | None = None, tasks: int = 200, **options) -> DataFrame:
    """Pages of the boards of a table: company, ats, token, and optionally url, method, body, accept, offset.

    Rows without a source or a token are left out; repeated boards are asked once. An error is a row of its board alone.
    """
    told = [c for c in ("company", "ats", "token", "url", "method", "body", "accept", "offset") if c in boards.columns]
    lanes = int(options.get("lanes", 1))
    rows = boards.select(*told).where("ats is not null and token is not null").dropDuplicates(["ats", "token", *(c for c in ("url",) if c in told)])
    # The host of a source with one address for all is the source; a lane of it is a key of its own.
    own = F.regexp_extract(F.coalesce(*(F.col(c) for c in ("url",) if c in told), F.col("token")), "^https?://([^/]+)", 1)
    dealt_by = rows.withColumn("_host", F.when(own != "", own).otherwise(F.col("ats"))).withColumn("_lane", F.pmod(F.xxhash64("token"), F.lit(lanes)))
    return dealt_by.repartition(tasks, "_host", "_lane").drop("_host", "_lane").mapInArrow(lambda b: _fetch_batches(b, options, now), PAGES)


def to_go_on(pages: DataFrame) -> DataFrame:
    """Boards whose last page failed, with the offset where a later run goes on; a board that failed at once starts anew."""
    last = pages.groupBy("company", "ats", "token").agg(F.max_by(F.struct("error", "page_offset"), F.struct("page_offset", F.col("error").isNotNull())).alias("last"))
    return last.where("last.error is not null").select("company", "ats", "token", F.col("last.page_offset").alias("offset"))
