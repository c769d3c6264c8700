"""Centroid clustering of whole-number vectors, nearest centroids by partial-distance search.

A vector's squared distance to a centroid only grows as dimensions are added. Dimensions are taken in the order of
their variance over the whole table, highest first: after the first few of them the centroid that is nearest so far is
measured in full, and every other one is dropped as soon as its part of the sum is strictly above that. What is left
at the end has been measured in all dimensions, ties included, so the result is that of measuring everything.

Each round is one pass over the vectors with the centroids broadcast (k times dims numbers, both parameters). A task
sends k * dims whole-number sums at most, whatever number of rows it has read, so no cluster gathers in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise, ship, type_of
from heddle.llm.vectors import blocks, usable, whole_numbers

#: Dimensions between two looks at which centroids are left.
STEP = 8
#: Rows times centroids that are worked on at a time.
CELLS = 1 << 16


@dataclass
class Clustering:
    """``centroids`` (k, dims), and ``rows`` (id, cluster, distance), one for each kept vector."""

    centroids: np.ndarray
    rows: DataFrame


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid of each row, squared distance, terms added); ties go to the smaller number."""
    cluster, distance, terms = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64), 0
    ordered = np.ascontiguousarray(centroids[:, order])
    for at in blocks(len(x), max(1, CELLS // len(centroids))):
        cluster[at], distance[at], n = _nearest(np.ascontiguousarray(x[at][:, order]), ordered, step)
        terms += n
    return cluster, distance, terms


def _nearest(x: np.ndarray, c: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, int]:
    n, dims = x.shape
    part = np.zeros((n, len(c)), np.int64)
    for d in range(min(step, dims)):
        part += np.square(x[:, d, None] - c[None, :, d])
    near = part.argmin(1)
    best = part[np.arange(n), near] + np.square(x[:, step:] - c[near, step:]).sum(1)
    terms = part.size * min(step, dims) + n * max(0, dims - step)
    left = part <= best[:, None]
    left[np.arange(n), near] = False
    row, cen = np.nonzero(left)
    sums = part[row, cen]
    for a in range(step, dims, step):
        if not len(row):
            break
        sums = sums + np.square(x[row, a : a + step] - c[cen, a : a + step]).sum(1)
        terms += len(row) * min(step, dims - a)
        alive = sums <= best[row]
        row, cen, sums = row[alive], cen[alive], sums[alive]
    if len(row):  # of each row the least sum, then the smallest number
        by = np.lexsort((cen, sums, row))
        row, cen, sums = row[by], cen[by], sums[by]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        row, cen, sums = row[first], cen[first], sums[first]
        closer = (sums < best[row]) | (cen < near[row])
        near[row[closer]], best[row[closer]] = cen[closer], sums[closer]
    return near, best, terms


def _moments(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Of each dimension the number, sum and sum of squares of a partition; these only order the dimensions."""
    n, total, squares = 0, np.zeros(dims), np.zeros(dims)
    for batch in batches:
        _, x = whole_numbers(batch.column(0), dims, scale)
        x = x.astype(np.float64)
        n, total, squares = n + len(x), total + x.sum(0), squares + np.square(x).sum(0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(total), pa.array(squares)], names=["d", "n", "total", "squares"])


def _sums(batches: Iterator[pa.RecordBatch], shared, dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Of each non-empty cluster and dimension the number and sum of a partition."""
    centroids, order = shared.value
    sums, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    for batch in batches:
        _, x = whole_numbers(batch.column(0), dims, scale)
        cluster, _, _ = nearest(x, centroids, order)
        np.add.at(sums, cluster, x)
        n += np.bincount(cluster, minlength=len(n))
    some = np.flatnonzero(n)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(some))), pa.array(sums[some].reshape(-1)), pa.array(np.repeat(n[some], dims))], names=["cluster", "d", "total", "n"])


def _assigned(batches: Iterator[pa.RecordBatch], shared, dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    centroids, order = shared.value
    for batch in batches:
        rows, x = whole_numbers(batch.column(1), dims, scale)
        cluster, distance, _ = nearest(x, centroids, order)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, salt: int = 1) -> Clustering:
    """Lloyd's rounds in whole numbers: every component x counts as floor(scale * x).

    Centroids start as the k kept vectors with the smallest SHA-256 (lower-case hex) of ``salt:id``, in that order; rows
    with equal ids are ordered by their vectors, and rows without an id come last. A round assigns every vector to
    its nearest centroid, ties to the smaller number, and moves each non-empty centroid to the floor of the mean of
    its vectors; then vectors are assigned once more.

    Vectors that are null, have another number of components than ``dims``, or hold null or non-finite ones are left out.
    Repeated rows count each time and come back each time. Fewer than k vectors make as many centroids; an empty table, or
    one without a kept vector, gives no rows and no centroids. Components whose squared distances do not fit 64 bits raise
    an error. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.where((F.size("v") == dims) & usable(F.col("v"))).select(name.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(k).collect()
    kind = f"id {type_of(df, id_col)}, cluster int, distance long"
    if not first:
        return Clustering(np.zeros((0, dims), np.int64), spark.createDataFrame([], kind))
    centroids = whole_numbers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dims, scale)[1]
    vectors = rows.select("v")
    spread = vectors.mapInArrow(lambda b: _moments(b, dims, scale), "d int, n long, total double, squares double").groupBy("d")
    spread = {r["d"]: r["q"] / r["m"] - (r["t"] / r["m"]) ** 2 for r in spread.agg(F.sum("n").alias("m"), F.sum("total").alias("t"), F.sum("squares").alias("q")).collect()}
    order = np.array(sorted(range(dims), key=lambda d: (-spread[d], d)))

    def with_centroids(run: Callable) -> Callable:
        shared = spark.sparkContext.broadcast((centroids.copy(), order))
        return lambda b: run(b, shared, dims, scale)

    for _ in range(rounds):
        sums = vectors.mapInArrow(with_centroids(_sums), "cluster int, d int, total long, n long").groupBy("cluster", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():  # k * dims rows
            centroids[r["cluster"], r["d"]] = r["total"] // r["n"]
    return Clustering(centroids, materialise(rows.mapInArrow(with_centroids(_assigned), kind), "clusters"))


def cluster_rows(found: Clustering) -> DataFrame:
    """``rows`` with cluster_inertia, inertia and centroid_sha256, the digest of the centroid's comma-joined components."""
    spark = found.rows.sparkSession
    sums = {r["cluster"]: r["s"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    told = [(i, sums.get(i, 0), total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(found.centroids)]
    # One row for each of k centroids, k a parameter.
    return found.rows.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")


def oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """DuckDB SQL of ``op11``: every distance in full, rounds unrolled."""
    distance = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::bigint"
    parts = [
        f"kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})",
        f"c0 as materialized (select h - 1 as c, q from (select row_number() over (order by sha256('1:' || vec_id), q) as h, q from kept) where h <= {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} as materialized (select r, any_value(vec_id) as vec_id, any_value(vq) as q, min(d * {k} + c) as best from (select v.r, v.vec_id, v.q as vq, c.c, {distance} as d from kept v, c{n} c) group by r)")
        if n < rounds:
            parts.append(f"s{n} as (select best % {k} as c, i, sum(q[i]) as s, count(*) as n from a{n}, range(1, {dims + 1}) t(i) group by all)")
            parts.append(f"m{n} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as q from s{n} group by c)")
            parts.append(f"c{n + 1} as materialized (select c.c, coalesce(m.q, c.q) as q from c{n} c left join m{n} m on c.c = m.c)")
    last = f"select vec_id, (best % {k})::integer as cluster, (best // {k})::bigint as distance from a{rounds}"
    names = f"select c, sha256(array_to_string(q, ',')) as centroid_sha256 from c{rounds}"
    return f"with {', '.join(parts)} select l.vec_id, l.cluster, l.distance, (sum(l.distance) over (partition by l.cluster))::bigint as cluster_inertia, (sum(l.distance) over ())::bigint as inertia, n.centroid_sha256 from ({last}) l join ({names}) n on l.cluster = n.c"
