"""Best-fit packing with certified bin counts.

Documents become token ids and an end id; longer ones than a sequence are cut into pieces. Pieces are dealt at random
to partitions of about GROUP pieces, and each is packed by best-fit decreasing. Dual-feasible functions over the
lengths of a partition bound its number of sequences from below: a partition that meets its bound is certified, and
no packing of its pieces has fewer sequences.

While the whole table stands above its own bound, partitions exchange documents: one with a gap gives up the sequences
that have room left, a certified one only its emptiest, so that remainders of many partitions meet. What is given up is
dealt anew by whole sequences, again about GROUP pieces each, and packed again; a new partition keeps the packing that it
was given unless its own has fewer sequences. So no exchange makes the total worse, no task holds more than a
partition, and the pieces that move get fewer with each round. Rounds end when the bound is met or none of the last
two helped.

Equal lengths are interchangeable, so a partition keeps, of each amount of room, the sequences that have it; the tightest
fit is the lowest set bit of a 4097-bit number above a piece's length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise, ship, type_of
from heddle.llm.token_output import _encoder

#: Ids of a sequence, pieces of a partition, and most exchanges.
CAPACITY, GROUP, EXCHANGES = 4096, 4096, 6
_SERIAL_BITS = 40


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that pieces need at least; ``counts[n]`` is the number of pieces of length n.

    The best of three families of dual-feasible functions (Fekete and Schepers; Carlier, Clautiaux and Moukrim): pieces
    above and below a threshold rounded to whole and to no sequences, multiples of (k + 1)-ths, and halves counted
    double. All in whole numbers.
    """
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return 0
    n = [int(x) for x in counts[lengths]]
    weight, size = np.array(n, np.int64), lengths.astype(np.int64)
    total = int((weight * size).sum())
    best = -(-total // capacity)
    # Thresholds: pieces over capacity - t count as a sequence, pieces under t as nothing.
    t = np.unique(np.concatenate([size[size <= capacity // 2], capacity - size[size > capacity // 2] + 1]))
    t = t[(t >= 1) & (t <= capacity // 2)]
    many, mass = np.concatenate([[0], np.cumsum(weight)]), np.concatenate([[0], np.cumsum(weight * size)])
    low, high = np.searchsorted(size, t, "left"), np.searchsorted(size, capacity - t, "right")
    if len(t):
        best = max(best, int((many[-1] - many[high] + -(-(mass[high] - mass[low]) // capacity)).max()))
    for k in range(1, 65):
        steps = size * (k + 1)
        value = np.where(steps % capacity == 0, size * k, steps // capacity * capacity)
        best = max(best, -(-int((weight * value).sum()) // (capacity * k)))
    twice = 2 * size
    for k in np.unique(np.concatenate([np.arange(1, min(65, capacity // 2 + 1)), t])).tolist():
        whole = capacity // k
        if whole:
            value = np.where(twice > capacity, 2 * (whole - (capacity - size) // k), np.where(twice == capacity, whole, 2 * (size // k)))
            best = max(best, -(-int((weight * value).sum()) // (2 * whole)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence of each piece, place in it, fill of each sequence); pieces are taken longest first, equals in order."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_rooms = 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_rooms >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            at = room[space].pop()
            if not room[space]:
                open_rooms ^= 1 << space
        else:
            at, space = len(fill), capacity
            fill.append(0)
        sequence[i], offset[i] = at, fill[at]
        fill[at] += size
        space -= size
        if space:
            room[space].append(at)
            open_rooms |= 1 << space
    return sequence, offset, np.array(fill, np.int64)


def cut(ids: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """(text, piece, start, length, crc) of each piece of texts that have these ids, one after the other."""
    pieces = -(-counts // capacity)
    text = np.repeat(np.arange(len(counts)), pieces)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    length = np.minimum(counts[text] - start, capacity)
    ends = np.cumsum(length)
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip((4 * (ends - length)).tolist(), (4 * ends).tolist(), strict=True)), np.int64, len(text))
    return text, piece, start, length, crc


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, piece, start, length, crc, serial); serial differs in every row of the table."""
    from pyspark import TaskContext

    encode, serial = _encoder(tokenizer), TaskContext.get().partitionId() << _SERIAL_BITS
    for batch in batches:
        for first, ids, counts in _whole_texts(encode.slices(batch.column(1))):
            text, piece, start, length, crc = cut(np.insert(ids, np.cumsum(counts), end_id), counts + 1, capacity)
            serials = np.arange(serial, serial + len(text))
            serial += len(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + text)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(serials)], names=["id", "piece", "start", "length", "crc", "serial"])


def _whole_texts(slices: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, number of ids of each text) of runs; the pieces of a long text are put together first."""
    held, now = [], next(slices, None)
    while now is not None:
        (a, b, ids, counts), now = now, next(slices, None)
        if now is not None and now[0] == a:
            held.append(ids)
        elif held:
            ids = np.concatenate([*held, ids])
            yield a, ids, np.array([len(ids)])
            held = []
        else:
            yield a, ids, counts


def _packed(table: pa.Table, capacity: int, round_no: int) -> pa.Table:
    """A partition's pieces with their sequence and place. ``sequence`` of the input is the present one, or null.

    ``free`` marks pieces whose sequence the partition gives up in the next exchange; ``bins``, ``bound`` and ``head`` tell
    once for each partition how it stands.
    """
    table = table.sort_by("serial")
    lengths = table["length"].to_numpy()
    sequence, offset, fill = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    group = table["part"][0].as_py()
    names = (round_no << 56) + (group << 24) + np.arange(len(fill))
    given = table["sequence"]
    if given.null_count == 0:
        kept, at = np.unique(given.to_numpy(), return_inverse=True)
        if len(kept) <= len(fill):  # nothing gained
            sequence, offset, names = at, table["offset"].to_numpy(), kept
            fill = np.bincount(at, lengths, len(kept)).astype(np.int64)
    loose = fill < capacity
    if len(fill) == bound:  # certified: only the emptiest
        loose &= np.arange(len(fill)) == fill.argmin()
    head = np.zeros(len(lengths), bool)
    head[0] = True
    columns = {"sequence": names[sequence], "offset": offset, "free": loose[sequence], "head": head, "bins": np.full(len(lengths), len(fill)), "bound": np.full(len(lengths), bound)}
    kept = table.select(["id", "piece", "start", "length", "crc", "serial"])
    for name, values in columns.items():
        kept = kept.append_column(name, pa.array(values))
    return kept


@dataclass
class Packing:
    """``rows`` (id, piece, start, length, crc, sequence, offset), and for each round (partitions, certified, sequences of
    the whole table), and the whole table's bound."""

    rows: DataFrame
    rounds: list[tuple[int, int, int]]
    bound: int


def pack(df: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP, exchanges: int = EXCHANGES) -> Packing:
    """Packs every row's ids and ``end_id`` into sequences of at most ``capacity`` ids.

    Only documents beyond ``capacity`` are cut, into pieces of that size; the last may be shorter. Null and empty texts are
    a lone end id. Repeated rows, and rows without an id, are packed each. A very long text is encoded in slices; its ids
    stand in memory once. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = f"id {type_of(df, id_col)}, piece int, start long, length long, crc long, serial long"
    pieces = materialise(rows.mapInArrow(lambda b: _pieces(b, tokenizer, end_id, capacity), kind), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    bound, packed_kind = lower_bound(counts, capacity), f"{kind}, sequence long, offset long, free boolean, head boolean, bins long, bound long"

    def packed(waiting: DataFrame, n: int, deal: str, round_no: int) -> DataFrame:
        parts = max(1, -(-n // group))
        dealt = waiting.withColumn("part", F.pmod(F.xxhash64(F.col(deal), F.lit(round_no)), F.lit(parts)))
        return materialise(dealt.groupBy("part").applyInArrow(lambda t: _packed(t, capacity, round_no), packed_kind), "packed")

    nothing = F.lit(None).cast("long")
    last = packed(pieces.withColumns({"sequence": nothing, "offset": nothing}), int(counts.sum()), "serial", 0)
    done, settled, rounds, idle = [], 0, [], 0
    for round_no in range(1, exchanges + 2):
        told = last.agg(
            F.count_if("head").alias("parts"), F.count_if(F.col("head") & (F.col("bins") == F.col("bound"))).alias("certified"), F.sum(F.when(F.col("head"), F.col("bins"))).alias("bins"),
            F.count_if("free").alias("free"), F.count_if(F.col("free") & (F.col("offset") == 0)).alias("loose"),
        ).first()
        total = settled + (told["bins"] or 0)
        rounds.append((told["parts"], told["certified"], total))
        idle = idle + 1 if len(rounds) > 1 and total == rounds[-2][2] else 0
        if total == bound or round_no > exchanges or idle == 2 or told["loose"] < 2:
            break
        done.append(last.where(~F.col("free")))
        settled += told["bins"] - told["loose"]
        last = packed(last.where("free").drop("free", "head", "bins", "bound"), told["free"], "sequence", round_no)
    out = last
    for part in done:
        out = out.unionByName(part)
    return Packing(out.select("id", "piece", "start", "length", "crc", "sequence", "offset"), rounds, bound)
