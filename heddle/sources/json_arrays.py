"""Files that each hold one JSON array, read in byte ranges: a file of any size is many tasks, and no row is a file.

Where an element ends depends on everything before it: on whether a byte is inside a string, and how deep. Both are sums
once escapes are settled within a range, so they are found in two passes. The first works out of every range, for either
way it may begin (inside a string or not), how its brackets add up and whether it turns inside out. Running sums over a
file's ranges, one row each, then say how each really begins. The second pass cuts each range's elements: those whose
opening bracket or comma lies in it; the last is read on beyond its end. Elements are parsed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = 32 << 20
_SIGNS = np.zeros(256, np.int8)
_SIGNS[[ord("["), ord("{")]] = 1
_SIGNS[[ord("]"), ord("}")]] = -1


def _open(path: str):
    from pyarrow.fs import FileSystem

    at = "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    source, inner = FileSystem.from_uri(at if "://" in at else f"file://{at}")
    return source.open_input_file(inner)


def _quotes(data: np.ndarray, run: int) -> np.ndarray:
    """Where the quotes are that no backslash escapes; ``run`` backslashes stand right before the data."""
    plain = np.maximum.accumulate(np.where(data != ord("\\"), np.arange(len(data)), -1))
    quotes = np.flatnonzero(data == ord('"'))
    before = np.where(quotes > 0, plain[np.maximum(quotes, 1) - 1], -1)
    slashes = quotes - 1 - before + np.where(before < 0, run, 0)
    return quotes[slashes % 2 == 0]


def _inside(data: np.ndarray, run: int, begins_inside: bool) -> tuple[np.ndarray, bool]:
    """(which bytes are inside a string, whether the next byte is)."""
    turns = np.zeros(len(data) + 1, np.int8)
    turns[_quotes(data, run) + 1] = 1
    parity = (np.cumsum(turns) + begins_inside) % 2 == 1
    return parity[:-1], bool(parity[-1])


def _slashes_before(file, start: int) -> int:
    run = 0
    while start - run > 0:
        step = min(256, start - run)
        file.seek(start - run - step)
        tail = file.read(step)
        more = len(tail) - len(tail.rstrip(b"\\"))
        run += more
        if more < step:
            break
    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with _open(r["file"]) as file:
                run = _slashes_before(file, r["start"])
                file.seek(r["start"])
                data = np.frombuffer(file.read(r["size"]), np.uint8)
            inside, turned = _inside(data, run, False)
            signs = _SIGNS[data].astype(np.int64)
            row = r | {"run": run, "odd": int(turned), "outside": int(signs[~inside].sum()), "inside": int(signs[inside].sum()), "first": data.tobytes().lstrip()[:1].decode("latin-1")}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("file", pa.string()), ("file_no", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("run", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64()), ("first", pa.string())]))


def separators(data: np.ndarray, run: int, inside: bool, depth: int) -> tuple[np.ndarray, bool, int]:
    """(places of the array's own brackets and commas, whether the next byte is inside a string, its depth)."""
    within, turned = _inside(data, run, inside)
    signs = np.where(within, 0, _SIGNS[data]).astype(np.int64)
    after = depth + np.cumsum(signs)
    before = after - signs
    opening, closing = (before == 0) & (after == 1), (before == 1) & (after == 0)
    return np.flatnonzero(opening | closing | ((after == 1) & (data == ord(",")) & ~within)), turned, int(after[-1]) if len(after) else depth


def _cut(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with _open(r["file"]) as file:
                file.seek(r["start"])
                raw = file.read(r["size"])
                data = np.frombuffer(raw, np.uint8)
                places, inside, depth = separators(data, r["run"], bool(r["is_inside"]), r["depth"])
                if not len(places):
                    continue
                # The last element goes on until the next separator, which may lie far beyond the range.
                pieces, tail = [raw[places[-1] + 1 :]], len(raw) - len(raw.rstrip(b"\\"))
                closed = depth == 0 and raw[places[-1] : places[-1] + 1] == b"]"
                while not closed:
                    more = file.read(step)
                    if not more:
                        break
                    found, inside, depth = separators(np.frombuffer(more, np.uint8), tail, inside, depth)
                    pieces.append(more[: found[0]] if len(found) else more)
                    closed = len(found) > 0
                    tail = len(more) - len(more.rstrip(b"\\"))
            told = [(a, raw[a + 1 : b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True) if raw[a : a + 1] != b"]"]
            if raw[places[-1] : places[-1] + 1] != b"]":
                told.append((int(places[-1]), b"".join(pieces)))
            told = [(r["start"] + a, x.strip()) for a, x in told if x.strip()]
            if told:
                at, values = zip(*told, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([r["file_no"]] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([v.decode("utf-8", "replace") for v in values])], names=["file_no", "at", "value"])


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(file, bytes) of what a path or glob names, by file name, then by path; folders give their files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    found = []
    for s in fs.globStatus(root) or ():
        inner = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [(x.getPath().toString(), x.getLen()) for x in inner if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return sorted(found, key=lambda f: (f[0].rsplit("/", 1)[-1], f[0]))


def elements(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """``(file_no, at, value)``: the elements of each file's array as text, with the file's place and theirs within it.

    ``at`` is the byte of the bracket or comma before an element, so it orders them. A file that is empty, does not begin with
    a bracket, or ends inside a string or below the outermost level is no array and gives no element.
    """
    ranges = [(f, n, a, min(size, length - a)) for n, (f, length) in enumerate(listed(spark, path)) for a in range(0, length, size)]
    kind = "file string, file_no long, start long, size long"
    if not ranges:
        return spark.createDataFrame([], "file_no long, at long, value string")
    # One row for each range; dealt out so that each is a task of its own as far as tasks go.
    tasks = min(len(ranges), 4096)
    rows = spark.createDataFrame(ranges, kind).repartition(tasks, "file_no", "start")
    measured = rows.mapInArrow(_measured, f"{kind}, run long, odd int, outside long, inside long, first string")
    of, before = Window.partitionBy("file_no"), Window.partitionBy("file_no").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = measured.withColumn("is_inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    begun = begun.withColumn("delta", F.when(F.col("is_inside") == 1, F.col("inside")).otherwise(F.col("outside")))
    begun = begun.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    whole = (F.sum("delta").over(of) == 0) & (F.sum("odd").over(of) % 2 == 0) & (F.min_by("first", F.when(F.col("first") != "", F.col("start"))).over(of) == "[")
    begun = begun.withColumn("whole", whole).where("whole").select("file", "file_no", "start", "size", "run", F.col("is_inside").cast("int").alias("is_inside"), "depth")
    # The sums have brought a file's ranges together: a few numbers each, which are dealt out again.
    return begun.repartition(tasks, "file_no", "start").mapInArrow(lambda b: _cut(b, 1 << 20), "file_no long, at long, value string")
