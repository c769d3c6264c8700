"""Embedding near-duplicates by product quantisation.

Fitted on a bounded sample of unit vectors: coarse centroids by k-means, and for each of M subspaces 256 codewords by
k-means over residuals. Every vector is indexed: the list of its nearest centroid, the codes of its residual, and
the length of what the codes leave out. Equal vectors of a label are indexed once, with their number.

Two unit vectors with a cosine of at least c lie within d = sqrt(2 - 2c) of each other. The search uses this twice:

* Probes. A vector within d of q can be in the list of centroid b, rather than in that of q's nearest centroid a, only
  if it lies past the plane halfway between them: its offset from q must reach |q-b|^2 - |q-a|^2 over 2 |a-b| along
  a-b. All lists within d are probed.
* Table look-ups. The asymmetric distance from q to a coded vector differs from the true one by at most the length
  the code leaves out, so codes farther than d plus that length are passed over.

Neither loses a link. What remains is reranked by the exact cosine in double precision. A label's lists are joined to
blocks of about LIST_CHUNK vectors, and a query goes to a block once, however many of its lists it probes; which these
are is worked out again there. Groups are (label, block, chunk of vectors, chunk of queries), so none grows with the
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import broadcast_if_small, materialise, ship, type_of
from heddle.llm.components import components

COSINE = 0.93
#: The index is fitted on at most so many vectors, the first in hash order.
SAMPLE = 20_000
SUBSPACES, CODEWORDS, ROUNDS = 8, 256, 8
#: About so many vectors of a block, and most queries, in one group.
LIST_CHUNK, QUERY_CHUNK = 2048, 4096
#: Queries and vectors whose distances are looked up at a time.
TILE = 256
#: What a distance may be off by, and a squared one that is summed in single precision.
_SLACK, _ROUNDING = 1e-6, 1e-4


@dataclass
class Index:
    centroids: np.ndarray
    codebooks: list[np.ndarray]
    splits: list[slice]


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from k distinct points; an empty cluster keeps its centre."""
    points = np.unique(x, axis=0)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def fit_index(sample: np.ndarray, n_rows: int, seed: int = 7) -> Index:
    """Fits centroids (about the square root of the number of rows, as far as the sample allows) and codebooks."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(int(math.sqrt(n_rows)), len(sample) // 8, 4096))
    dims = sample.shape[1]
    edges = np.linspace(0, dims, min(SUBSPACES, dims) + 1).astype(int)
    splits = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    centroids = _kmeans(sample, lists, ROUNDS, rng)
    residual = sample - centroids[_nearest(sample, centroids)]
    return Index(centroids, [_kmeans(residual[:, s], CODEWORDS, ROUNDS, rng) for s in splits], splits)


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, codes, length left out) of unit vectors."""
    coarse = _nearest(x, index.centroids)
    residual = x - index.centroids[coarse]
    codes = np.stack([_nearest(residual[:, s], b) for s, b in zip(index.splits, index.codebooks, strict=True)], 1).astype(np.uint8)
    known = np.concatenate([b[codes[:, j]] for j, b in enumerate(index.codebooks)], 1)
    return coarse, codes, np.sqrt(((residual - known) ** 2).sum(1))


def probes(index: Index, x: np.ndarray, reach: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for every list that can hold a vector within ``reach`` of the row.

    Given each row's own list, only lists up to it: a pair of two lists is then found from the side of the later one alone.
    """
    far = _squares(x, index.centroids)
    near = far.argmin(1) if own is None else own
    between = np.sqrt(_squares(index.centroids, index.centroids))[near]
    can = far - far[np.arange(len(x)), near][:, None] <= 2 * reach * between + _SLACK
    return np.nonzero(can if own is None else can & (np.arange(len(index.centroids)) <= own[:, None]))


@dataclass
class Coded:
    """Vectors of some lists as the index holds them, sorted by list. ``fixed`` is the part of a distance that no query changes."""

    x: np.ndarray
    lists: np.ndarray
    codes: np.ndarray
    left: np.ndarray
    fixed: np.ndarray


def coded(index: Index, x: np.ndarray, lists: np.ndarray, codes: np.ndarray, left: np.ndarray) -> Coded:
    known = np.concatenate([b[codes[:, j]] for j, b in enumerate(index.codebooks)], 1)
    return Coded(x, lists, codes, left, ((index.centroids[lists] + known) ** 2).sum(1))


def search(index: Index, coarse: int, db: np.ndarray, codes: np.ndarray, left: np.ndarray, queries: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs of one list whose cosine reaches the threshold; all rows are unit vectors."""
    held = coded(index, db, np.full(len(db), coarse), codes, left)
    return search_lists(index, held, queries, np.full(len(queries), coarse), cosine, math.sqrt(max(0.0, 2 - 2 * cosine)))


def search_lists(index: Index, db: Coded, queries: np.ndarray, own: np.ndarray, cosine: float, probed: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs whose cosine reaches the threshold, the vector's list not after the query's; all rows are unit
    vectors, and queries are sorted by their own list. ``probed`` is the reach of probes.

    The distance to a coded vector c + r is |q|^2 - 2 q.c - 2 q.r + |c + r|^2. Its q.r is a sum of one table entry for each
    subspace, and the tables are the same for all lists, so a tile of queries and vectors takes all of its look-ups at once.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    bound = ((reach + db.left + _SLACK) ** 2 + _ROUNDING - db.fixed).astype(np.float32)
    starts = np.flatnonzero(np.r_[True, db.lists[1:] != db.lists[:-1]])
    rows, cols = [], []
    for at in range(0, len(queries), TILE):
        q, mine = queries[at : at + TILE], own[at : at + TILE]
        row, asked = probes(index, q, probed, mine)
        wanted = np.zeros((len(index.centroids), len(q)), bool)
        wanted[asked, row] = True
        some = np.repeat(wanted.any(1)[db.lists[starts]], np.diff(np.r_[starts, len(db.lists)]))
        held = np.flatnonzero(some)
        squares = (q**2).sum(1).astype(np.float32)
        tables = [(-2 * book @ q[:, s].T).astype(np.float32) for s, book in zip(index.splits, index.codebooks, strict=True)]
        coarse = (-2 * index.centroids @ q.T).astype(np.float32) + squares
        for first in range(0, len(held), TILE):
            k = held[first : first + TILE]
            total = coarse[db.lists[k]]
            for table, code in zip(tables, db.codes[k].T, strict=True):
                total += table[code]
            near = total <= bound[k][:, None]
            near &= wanted[db.lists[k]]
            v, i = np.nonzero(near)
            if len(v) * 16 > near.size:  # many: all products of the tile at once come cheaper, and thin them
                v, i = np.nonzero(near & (db.x[k] @ q.T >= cosine - _SLACK))
            exact = np.einsum("ij,ij->i", q[i], db.x[k[v]])
            keep = exact >= cosine
            rows.append(i[keep] + at)
            cols.append(k[v[keep]])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _unit(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.sqrt((x**2).sum(1))[:, None]


def _index_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    index = shared.value
    for batch in batches:
        if batch.num_rows:
            coarse, codes, left = encode(index, _unit(batch.column("v")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coarse.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], names=[*batch.schema.names, "list", "codes", "left_out"])


def _probe_batches(batches: Iterator[pa.RecordBatch], shared, reach: float) -> Iterator[pa.RecordBatch]:
    index = shared.value
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            row, lists = probes(index, _unit(part.column("v")), reach, part.column("list").to_numpy())
            ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("class_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.astype(np.int32)))], names=["label", "class_id", "lists"])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := find(x)) != (q := find(y)):
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _by_list(rows: pd.DataFrame, x: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    order = np.argsort(rows["list"].to_numpy(), kind="stable")
    return rows.iloc[order], x[order]


def _search_group(shared, cosine: float, reach: float):
    def run(key: tuple, db: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"q": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        if db.empty or queries.empty:
            return nothing
        x, q = (np.stack(d["v"].to_numpy()).astype(np.float64) for d in (db, queries))
        x, q = (y / np.sqrt((y**2).sum(1))[:, None] for y in (x, q))
        db, x, queries, q = *_by_list(db, x), *_by_list(queries, q)
        codes = np.frombuffer(b"".join(db["codes"]), np.uint8).reshape(len(db), -1)
        lists, own = db["list"].to_numpy(), queries["list"].to_numpy()
        held = coded(shared.value, x, lists, codes, db["left_out"].to_numpy())
        i, k = search_lists(shared.value, held, q, own, cosine, reach)
        ids, qids = db["class_id"].to_numpy(), queries["class_id"].to_numpy()
        other = ids[k] != qids[i]
        i, k = i[other], k[other]
        # Vectors of one list ask for each other; of two lists only one asks, and its find counts for both.
        counts = np.bincount(i, db["copies"].to_numpy()[k].astype(np.float64), minlength=len(queries)).astype(np.int64)
        both = lists[k] != own[i]
        back = np.bincount(k[both], queries["copies"].to_numpy()[i[both]].astype(np.float64), minlength=len(db)).astype(np.int64)
        links = _forest(qids[i], ids[k])
        who, n = np.concatenate([qids[counts > 0], ids[back > 0]]), np.concatenate([counts[counts > 0], back[back > 0]])
        return pd.DataFrame({"q": np.concatenate([who, np.array([a for a, _ in links], np.int64)]), "v": np.concatenate([np.full(len(who), -1), np.array([b for _, b in links], np.int64)]), "n": np.concatenate([n, np.zeros(len(links), np.int64)])})

    return run


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, sample: int = SAMPLE, deviations: float = math.inf) -> DataFrame:
    """``(id, n_links, component, kept)`` for every row.

    Probes reach ``deviations`` of a link's offset along a line past a cell's border, or its whole length if that is less.
    Rows are compared within equal labels only. A null label, a null, empty or zero vector, and one with null or
    non-finite components or another number of components than the table's most common one link with nothing. Equal
    vectors of a label link with each other. Rows with equal ids count as separate rows. ``component`` is the smallest
    id reachable; a null id has none unless it is linked. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship(spark)
    id_type = type_of(df, id_col)
    doubles = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), doubles.alias("v"), F.col(label_col).alias("label"))
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & fine, F.lit(False))
    # Vectors are hashed to 128 bits to name their class; -0.0 counts as 0.0.
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = rows.withColumn("usable", usable).withColumn("v", F.when(F.col("usable"), plain))
    rows = rows.withColumn("key", F.when(F.col("usable"), F.md5(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: F.hex(x.cast("string")))).cast("binary"))))
    rows = materialise(rows, "vectors")
    classes = rows.where("usable").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    classes = classes.withColumn("class_id", F.pmod(F.xxhash64("key"), F.lit((1 << 62) - 1)))
    classes = materialise(classes, "classes")
    sizes = classes.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    even = classes.where(F.size("v") == sizes["dims"])
    # A share of the hash range holds slightly more than the sample; its rows are ordered here, not by every task.
    order = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    share = min(1.0, 1.1 * sample / sizes["count"] + 100 / sizes["count"])
    drawn = even.withColumn("order", order).where(F.col("order") <= share * (1 << 40)).select("order", "key", "v").toPandas()
    drawn = drawn.sort_values(["order", "key"]).head(sample)
    x = np.stack(drawn["v"].to_numpy()).astype(np.float64)
    x /= np.sqrt((x**2).sum(1))[:, None]
    shared = spark.sparkContext.broadcast(fit_index(x, sizes["count"]))

    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) * min(1.0, deviations / math.sqrt(sizes["dims"]))
    base = "label " + type_of(df, label_col) + ", v array<double>, copies long, class_id long"
    narrow = even.select("label", "v", "copies", "class_id")
    listed = materialise(narrow.mapInArrow(lambda b: _index_batches(b, shared), f"{base}, list int, codes binary, left_out double"), "lists")
    # Lists of a label side by side make a block of about LIST_CHUNK vectors; a longer list is one, in chunks.
    counts = listed.groupBy("label", "list").count()
    before = Window.partitionBy("label").orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.withColumn("block", F.floor(F.coalesce(F.sum("count").over(before), F.lit(0)) / LIST_CHUNK))
    blocks = broadcast_if_small(materialise(blocks, "blocks"), 100_000)
    # Probes are names alone until each query has one row for each of its blocks.
    label_type = "label " + type_of(df, label_col)
    probing = listed.select("label", "v", "class_id", "list").mapInArrow(lambda b: _probe_batches(b, shared, reach), f"{label_type}, class_id long, lists array<int>")
    asked = probing.select("label", "class_id", F.explode("lists").alias("list")).join(blocks, ["label", "list"]).select("label", "block", "class_id").distinct()
    asked = materialise(asked, "probes")
    asking = listed.select("class_id", *(F.col(c).alias(c) for c in ("v", "copies", "list")))
    listed = listed.join(blocks.select("label", "list", "block"), ["label", "list"])
    # A block of n vectors has ceil(n / LIST_CHUNK) chunks, and its queries as many as they need; each pair of
    # chunks is a group, and each side is copied to the chunks of the other.
    a = blocks.groupBy("label", "block").agg(F.ceil(F.sum("count") / LIST_CHUNK).alias("n_db"))
    b = asked.groupBy("label", "block").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).alias("n_q"))
    chunks = broadcast_if_small(materialise(a.join(b, ["label", "block"]), "chunks"), 100_000)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    db = listed.join(chunks, ["label", "block"]).withColumn("dc", F.pmod(F.xxhash64("class_id"), "n_db")).withColumn("qc", every("n_q"))
    queries = asked.join(asking, "class_id").join(chunks, ["label", "block"])
    queries = queries.withColumn("qc", F.pmod(F.xxhash64("class_id"), "n_q")).withColumn("dc", every("n_db"))
    keys = ["label", "block", "dc", "qc"]
    found = db.select(*keys, "list", "class_id", "v", "copies", "codes", "left_out").groupBy(*keys).cogroup(queries.select(*keys, "list", "class_id", "v", "copies").groupBy(*keys))
    found = materialise(found.applyInPandas(_search_group(shared, cosine, reach), "q long, v long, n long"), "found")

    linked = found.where("n > 0").groupBy(F.col("q").alias("class_id")).agg(F.sum("n").alias("n"))
    roots = materialise(components(found.where("v >= 0").select(F.col("q").alias("u"), "v")), "roots")
    named = classes.select("key", "class_id", "copies", "least").join(linked, "class_id", "left").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
    named = named.withColumn("root", F.coalesce("root", "class_id"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component")
    joined = rows.select("id", "key").join(named, "key", "left")
    component = F.coalesce("component", "id")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast(id_type).alias("component"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
