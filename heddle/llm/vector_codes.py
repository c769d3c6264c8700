"""Vector code compression: a codebook for each part position, fitted by an RDD's treeAggregate.

Vectors become columnar blocks once: whole-number components, dimension by dimension, as bytes of at most BLOCK rows,
stored in the shared folder. A round works on blocks alone. In a task, the distances of a part to all entries
accumulate one dimension at a time over a block's column; ``np.add.at`` adds each part to the sum and count of its entry;
and these tensors (parts * entries * width numbers, whatever the input) merge through a reduction tree, so that the driver
receives a few of them. The last pass writes codes row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise, ship, type_of, unused
from heddle.llm.vectors import blocks, usable, whole_numbers

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block.
BLOCK = 8192
#: Labels whose sums a broadcast may hold; more are joined by salted keys.
FEW_LABELS, SALTS = 50_000, 16


@dataclass
class Codes:
    """``codebooks`` (parts, entries, width), and ``rows`` (id, label, code, error), one for each kept vector."""

    codebooks: np.ndarray
    rows: DataFrame


def nearest_entries(columns: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each column, squared distance) of one part: ``columns`` (width, n), ``codebook`` (entries, width)."""
    distance = np.zeros((columns.shape[1], len(codebook)), np.int64)
    for values, centres in zip(columns, codebook.T, strict=True):
        distance += np.square(values.astype(np.int64)[:, None] - centres[None, :])
    entry = distance.argmin(1)
    return entry, distance[np.arange(len(entry)), entry]


def _block_batches(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, x = whole_numbers(batch.column(0), dims, scale)
        if len(x):
            found = [np.ascontiguousarray(x[at].T).astype("<i8").tobytes() for at in blocks(len(x), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["data"])


def add_block(sums: tuple[np.ndarray, np.ndarray] | None, data: bytes, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (sum, count) tensors with a block's parts added to their nearest entries."""
    parts, entries, width = codebooks.shape
    total, count = sums or (np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64))
    columns = np.frombuffer(data, "<i8").reshape(parts, width, -1)
    for p in range(parts):
        entry, _ = nearest_entries(columns[p], codebooks[p])
        np.add.at(total[p], entry, columns[p].T)
        np.add.at(count[p], entry, 1)
    return total, count


def merge_sums(a, b):
    """Two tensors as one; a partition without blocks has none."""
    if a is None or b is None:
        return a or b
    return a[0] + b[0], a[1] + b[1]


def _encode_batches(batches: Iterator[pa.RecordBatch], shared, dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    codebooks = shared.value
    parts, entries, width = codebooks.shape
    digits = len(f"{max(entries - 1, 255):x}")
    hexes = [f"{i:0{digits}x}" for i in range(entries)]
    for batch in batches:
        rows, x = whole_numbers(batch.column(2), dims, scale)
        for at in blocks(len(rows), BLOCK):
            columns, error, codes = x[at].T.reshape(parts, width, -1), 0, []
            for p in range(parts):
                entry, distance = nearest_entries(columns[p], codebooks[p])
                error = error + distance
                codes.append(entry)
            text = ["".join(map(hexes.__getitem__, code)) for code in np.stack(codes, 1).tolist()]
            take = pa.array(rows[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codebooks and codes of all vectors: components are floor(scale * x), cut into ``parts`` equal consecutive parts.

    Each part position's codebook starts as that part of the ``entries`` smallest ids, ascending; rows with equal ids are
    ordered by their vectors, and rows without an id come last. A round assigns every part to its nearest entry, ties to
    the lower index, and moves each used entry to the floor of the mean of its parts. Then parts are assigned again.

    Rows whose vector is null or holds null or non-finite components are left out. Vectors whose length is not the most
    common one that ``parts`` divides (ties: the shorter) have no place in the codebooks: they come back with null code
    and error. Repeated rows count each time. Fewer vectors than entries make as many entries. An empty table gives no
    rows. Components whose squared distances do not fit 64 bits raise an error. Other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = rows.where(usable(F.col("v")))
    length = kept.groupBy(F.size("v").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0)).orderBy(F.desc("count"), "n").first()
    kind = f"id {type_of(df, id_col)}, label {type_of(df, label_col)}, code string, error long"
    others = kept.where(F.lit(True) if length is None else F.size("v") != length["n"]).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if length is None:
        return Codes(np.zeros((parts, 0, 0), np.int64), others)
    dims = length["n"]
    first = kept.where(F.size("v") == dims).select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    start = whole_numbers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dims, scale)[1]
    codebooks = np.ascontiguousarray(start.reshape(len(first), parts, dims // parts).transpose(1, 0, 2))
    data = materialise(rows.select("v").mapInArrow(lambda b: _block_batches(b, dims, scale), "data binary"), "blocks")
    stored = data.rdd.map(lambda r: bytes(r[0]))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(codebooks)
        total, count = stored.treeAggregate(None, lambda sums, block, shared=shared: add_block(sums, block, shared.value), merge_sums, depth=3)
        used = count > 0
        codebooks = codebooks.copy()
        codebooks[used] = total[used] // count[used][:, None]
    shared = spark.sparkContext.broadcast(codebooks)
    coded = rows.mapInArrow(lambda b: _encode_batches(b, shared, dims, scale), kind)
    return Codes(codebooks, materialise(coded.unionByName(others), "codes"))


def code_rows(found: Codes) -> DataFrame:
    """``rows`` with label_error, the errors summed over equal labels (nulls together), and codebooks_sha256.

    Sums meet in tasks by label after each task has summed its own rows; they come back to rows by a broadcast if labels
    are few, else by label and one of SALTS numbers, so that the rows of a common label stay spread.
    """
    rows = found.rows
    told = hashlib.sha256(",".join(map(str, found.codebooks.reshape(-1).tolist())).encode()).hexdigest()
    sums = materialise(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    if len(sums.take(FEW_LABELS + 1)) <= FEW_LABELS:
        joined = rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")), "left")
    else:
        salt = unused(rows, "salt")
        sums = sums.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn(salt, F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        joined = salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col(salt) == F.col("salt_of")), "left")
    return joined.select("id", "label", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dims: int = 64) -> str:
    """DuckDB SQL of ``op13`` for tables whose vectors all have ``dims`` components, rounds unrolled."""
    width = dims // parts
    distance = " + ".join(f"(v.q[{i}] - c.q[{i}]) * (v.q[{i}] - c.q[{i}])" for i in range(1, width + 1))
    ctes = [
        f"kept as materialized (select row_number() over (order by vec_id, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding))",
        f"cut as materialized (select r, p, list_slice(q, p * {width} + 1, p * {width} + {width}) as q from kept, range({parts}) t(p))",
        f"c0 as materialized (select p, r - 1 as e, q from cut where r <= {entries})",
    ]
    for n in range(rounds + 1):
        ctes.append(f"a{n} as materialized (select v.r, v.p, any_value(v.q) as q, min(({distance}) * {entries} + c.e) as best from cut v join c{n} c on v.p = c.p group by v.r, v.p)")
        if n < rounds:
            ctes.append(f"s{n} as (select p, best % {entries} as e, i, sum(q[i]) as s, count(*) as n from a{n}, range(1, {width + 1}) t(i) group by all)")
            ctes.append(f"m{n} as (select p, e, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as q from s{n} group by p, e)")
            ctes.append(f"c{n + 1} as materialized (select c.p, c.e, coalesce(m.q, c.q) as q from c{n} c left join m{n} m on c.p = m.p and c.e = m.e)")
    coded = f"select r, string_agg(lpad(lower(to_hex(best % {entries})), 2, '0'), '' order by p) as code, sum(best // {entries})::bigint as error from a{rounds} group by r"
    books = f"select sha256(string_agg(array_to_string(q, ','), ',' order by p, e)) as codebooks_sha256 from c{rounds}"
    return f"with {', '.join(ctes)} select k.vec_id, x.code, x.error, (sum(x.error) over (partition by k.label))::bigint as label_error, b.codebooks_sha256 from kept k join ({coded}) x on k.r = x.r, ({books}) b"
