"""Ordered picks and merges by key. Every order ends in a unique column, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _orders(order: list) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. An aggregation with map-side combining, so a hot key costs one row per task.

    ``order`` must be ascending columns of orderable types; see :func:`pick` for any other order.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*_orders(order))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col("_best")[c].alias(c) for c in rest)).select(*df.columns)


def last_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key, likewise."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*_orders(order))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col("_best")[c].alias(c) for c in rest)).select(*df.columns)


def pick(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key in any order. Spark prunes each partition's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_orders(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def append_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Old rows stay; of new ones the first of each key that is not there yet is added."""
    return old.unionByName(first_per_key(new.join(old.select(*keys), keys, "left_anti"), keys, order), allowMissingColumns=True)


def overwrite(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """New rows replace old ones of their key; of several new ones the last."""
    latest = last_per_key(new, keys, order)
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest, allowMissingColumns=True)


def overlay(frames: list[DataFrame], keys: list[str], order: list) -> DataFrame:
    """Whole rows by precedence: a later frame's row replaces an earlier one's."""
    out = None
    for level, df in enumerate(frames):
        ranked = df.withColumn("_level", F.lit(level))
        out = ranked if out is None else out.unionByName(ranked)
    return pick(out, keys, [F.desc("_level"), *_orders(order)]).drop("_level")


def fill_missing(df: DataFrame, keys: list[str], order: list, blank: str | None = "") -> DataFrame:
    """One row per key: each column's first value that is neither null nor blank, in order."""
    at = F.struct(*_orders(order))
    rest = [c for c in df.columns if c not in keys and c not in [o for o in order if isinstance(o, str)]]
    kinds = dict(df.dtypes)

    def first_known(c: str) -> Column:
        value = F.nullif(F.col(c), F.lit(blank)) if kinds[c] == "string" and blank is not None else F.col(c)
        return F.min_by(c, F.when(value.isNotNull(), at)).alias(c)

    return df.groupBy(*keys).agg(*map(first_known, rest))


def replace_source(old: DataFrame, new: DataFrame, source: str, name: str) -> DataFrame:
    """One source's rows replaced, the others kept."""
    return old.where(~F.col(source).eqNullSafe(F.lit(name))).unionByName(new, allowMissingColumns=True)


def add_counts(old: DataFrame, new: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Counters added up by key."""
    return old.select(key, *counters).unionByName(new.select(key, *counters)).groupBy(key).agg(*(F.sum(c).alias(c) for c in counters))


def _dealt_by_range(df: DataFrame, order: list, parts: int) -> tuple[DataFrame, dict[int, int]]:
    """``df`` with ``_range``, the number of the key range that a row lies in, and the rows of each range.

    Ranges are cut at keys that a hash draws, fewer than ``parts`` of them, so they are the same whenever they are worked
    out, and about even where keys are distinct. Only key columns are read for this.
    """
    keys = df.select(F.struct(*_orders(order)).alias("k"))
    drawn = keys.orderBy(F.xxhash64("k"), "k").limit(max(1, parts) - 1).orderBy("k")
    cuts = df.sparkSession.createDataFrame([([r["k"] for r in drawn.collect()],)], f"_cuts array<{drawn.dtypes[0][1]}>")

    def ranged(rows: DataFrame, key: Column) -> DataFrame:
        return rows.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= key))).drop("_cuts")  # one row

    counts = {r["_range"]: r["count"] for r in ranged(keys, F.col("k")).groupBy("_range").count().collect()}
    return ranged(df, F.struct(*_orders(order))), counts


def ranked(df: DataFrame, order: list, name: str = "rank", parts: int = 128, only: list[tuple[int, int]] | None = None) -> DataFrame:
    """``df`` with each row's place from 0 on in ascending ``order`` over the whole table, which ends in a unique column.

    No task sees more than a range of keys: rows are ranked within their range, and the rows of the ranges before are added.
    ``only`` names the places that are wanted, as (first, end) pairs; ranges that hold none of them are not ranked.
    """
    rows, counts = _dealt_by_range(df, order, parts)
    before, at = {}, 0
    for r in sorted(counts):
        before[r], at = at, at + counts[r]
    if only is not None:
        before = {r: x for r, x in before.items() if any(a < x + counts[r] and b > x for a, b in only)}
    if not before:
        return df.withColumn(name, F.lit(None).cast("long")).limit(0)
    starts = F.create_map(*(F.lit(x) for r, n in before.items() for x in (r, int(n))))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*_orders(order))) - 1 + F.element_at(starts, F.col("_range"))
    return rows.where(F.col("_range").isin(*before)).withColumn(name, place.cast("long")).drop("_range")


def rotating_slice(df: DataFrame, order: list, cursor: int, size: int) -> DataFrame:
    """``size`` rows from a cursor on, wrapping around; the new cursor is (cursor + rows) mod all rows.

    ``turn`` is a row's place in the slice. Only the key ranges that the slice touches are ranked; see :func:`ranked`.
    """
    n = df.count()
    if not n:
        return df.withColumn("turn", F.lit(None).cast("long")).limit(0)
    cursor, size = cursor % n, min(size, n)
    wanted = [(cursor, min(cursor + size, n)), (0, cursor + size - n)]
    turn = F.pmod(F.col("_at") - F.lit(cursor), F.lit(n))
    return ranked(df, order, "_at", only=[w for w in wanted if w[1] > w[0]]).withColumn("turn", turn.cast("long")).where(F.col("turn") < size).drop("_at")


def next_cursor(n_rows: int, cursor: int, size: int) -> int:
    return (cursor + min(size, n_rows)) % n_rows if n_rows else 0


def sample_per_key(df: DataFrame, keys: list[str], row_id: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each key by a seeded hash, so that the sample repeats."""
    return pick(df, keys, [F.xxhash64(F.col(row_id), F.lit(seed)), row_id], n)


def capped_list(df: DataFrame, keys: list[str], value: str, order: list, cap: int) -> DataFrame:
    """Each key's true count and its first ``cap`` values; only capped lists are ever gathered."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    named = [F.col(o).alias(f"_{i}") if isinstance(o, str) else o.alias(f"_{i}") for i, o in enumerate(order)]
    first = pick(df, keys, order, cap).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*named, F.col(value).alias("_v")))).alias("_l"))
    return counts.join(first.select(*keys, F.transform("_l", lambda x: x["_v"]).alias("first_values")), keys)
