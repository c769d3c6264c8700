"""Text search by an index of trigrams, with the same rows as scanning.

A trigram is three code points of a lower-cased field as one number. A posting list is cut into chunks of CHUNK consecutive
ids, so the list of a common trigram is many rows and no group grows with the table. The index lies in folders by a
hash of the trigram, sorted by it: a search reads the folders of its own trigrams, and in these the row groups that hold
them. Lists are intersected chunk by chunk, what is left is looked up in the rows and checked there. Rows that have
changed since stay in their old lists, which costs a check and changes no result; new and changed rows are added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.names import text

#: Bits of an id within its chunk, folders of an index, and the fields that are searched.
CHUNK_BITS, FOLDERS = 15, 64
FIELDS = ("company", "title", "location")
INDEX = "gram long, chunk long, ids array<long>, folder int"


def grams_of(value: str) -> np.ndarray:
    """The distinct trigrams of a text in ascending order; none below three characters."""
    points = np.frombuffer(value.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, ids, n = [], [], 0

    def told() -> pa.RecordBatch:
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.repeat(np.array(ids, np.int64), sizes))], names=["gram", "id"])

    for batch in batches:
        fields = [c.to_pylist() for c in batch.columns[1:]]
        for i, row_id in enumerate(batch.column(0).to_pylist()):
            held.append(np.unique(np.concatenate([grams_of(f[i]) for f in fields])))
            ids.append(row_id)
            n += len(held[-1])
            if n >= 1 << 18:
                yield told()
                held, ids, n = [], [], 0
    if held:
        yield told()


def folder_of(gram: Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(folders)).cast("int")


def posting_lists(rows: DataFrame, row_id: str = "id", fields: Sequence[str] = FIELDS, folders: int = FOLDERS) -> DataFrame:
    """The index of rows with ids; rows without an id, and null fields, are in no list."""
    texts = rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), *(F.lower(text(F.col(c))).alias(c) for c in fields))
    grams = texts.mapInArrow(_gram_batches, "gram long, id long")
    chunked = grams.groupBy("gram", F.shiftright("id", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return chunked.withColumn("folder", folder_of(F.col("gram"), folders))


def write_index(lists: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One sorted file or more for each folder; ``append`` adds the lists of new rows."""
    lists.repartition("folder").sortWithinPartitions("folder", "gram", "chunk").write.mode(mode).partitionBy("folder").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def candidates(index: DataFrame, wanted: str, folders: int = FOLDERS) -> DataFrame | None:
    """Ids of rows that have all trigrams of a text; None where it has none, so that only a scan can tell.

    Chunks in which a trigram has no list fall out before any list is intersected.
    """
    found = [int(g) for g in grams_of(wanted.lower())]
    if not found:
        return None
    spark = index.sparkSession
    places = sorted({r[0] for r in spark.createDataFrame([(g,) for g in found], "g long").select(folder_of(F.col("g"), folders)).collect()})
    lists = index.where(F.col("folder").isin(*places) & F.col("gram").isin(*found))
    # Lists of one trigram and chunk may come from several appends.
    joined = lists.groupBy("chunk", "gram").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    both = joined.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.collect_list("ids").alias("lists")).where(F.col("n") == len(found))
    least = F.array_sort("lists", lambda a, b: F.size(a) - F.size(b))
    met = F.aggregate(F.slice(least, 2, len(found)), F.array_distinct(F.element_at(least, 1)), F.array_intersect)
    return both.select(F.explode(met).alias("id"))


def contains_text(wanted: str, fields: Sequence[str] = FIELDS) -> Column:
    q = F.lit(wanted.lower())
    out = F.lit(False)
    for c in fields:
        out = out | F.contains(F.lower(text(F.col(c))), q)
    return out


def search(rows: DataFrame, index: DataFrame, wanted: str, row_id: str = "id", fields: Sequence[str] = FIELDS, folders: int = FOLDERS) -> DataFrame:
    """Rows that contain a text in one of their fields, case aside: those that scanning finds. Below three characters it scans."""
    ids = candidates(index, wanted, folders)
    near = rows if ids is None else rows.join(ids.withColumnRenamed("id", "_found"), F.col(row_id).cast("long") == F.col("_found"), "left_semi")
    return near.where(contains_text(wanted, fields))
