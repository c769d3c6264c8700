"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sizes are counted in words; sources in code-point order (null last) weigh 1, 2, 3 and so on again, and share the
   corpus. A target stops at MAX_REPEATS times its source; what it leaves is shared again by weight (water-filling).
2. A source's documents lie on a tape in hashed order, large ones first (those over 1/LARGE_SHARE of their source, so
   fewer than LARGE_SHARE of them). The tape is passed as often as the target holds the source whole; the rest of the
   target takes each large document whose turn an error-diffusing count says it is, and then the small ones
   from the start until the target is met, to half a small document.
3. The tape is cut into blocks. A binary tree halves the number of blocks from node to node; at each node the left child
   draws how many blocks of each source it gets without replacement, so that all leaves (output shards) get the
   same number of blocks and each source's quota is met exactly.
4. Shards draw disjoint ranges of each source's permuted blocks, and order their documents by hash.

All of it is DataFrame expressions. Prefix sums run in two levels (within hash buckets of some 2,000 rows, then over
bucket sums), so a source that holds a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import WORD, broadcast_if_small, materialise, row_keyed, unused

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SHARD_LEVELS = 4
BLOCK_WORDS = 4096
LARGE_SHARE = 2048
BUCKET_ROWS = 2048
#: Up to so many sources are broadcast; beyond it Spark joins them by shuffle.
BROADCAST_SOURCES = 10_000
#: Rounds of the permutation of block numbers.
ROUNDS = 48
_SEED = 20_011


def word_count(text: Column) -> Column:
    """How many runs of non-white-space characters; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` -> with rank, weight and target; one row per source, null its own, last."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("rank", F.lit(len(WEIGHTS))).cast("int") + 1)
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(MAX_REPEATS)))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("full_before", F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", (F.col("total") - F.col("full_before")) / F.col("weight_from") * F.col("weight") >= F.col("most"))
    )
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0))
    share = left / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return filled.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(share * F.col("weight"))).select("source", "source_size", "rank", "weight", "target")


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The number of marked items among ``drawn`` of ``total`` without replacement, by inversion at 0 <= u < 1.

    Sums over ten deviations around the mode; the mass outside is below 1e-20.
    """
    lo, hi = F.greatest(F.lit(0), drawn - (total - marked)), F.least(drawn, marked)
    part = marked / F.greatest(total, F.lit(1))
    mean = drawn * part
    wide = F.ceil(10 * F.sqrt(F.greatest(mean * (1 - part), F.lit(0.0))) + 10).cast("long")
    start, end = F.greatest(lo, F.floor(mean) - wide), F.least(hi, F.floor(mean) + wide)

    def weigh(w: Column, k: Column) -> Column:
        """The weight of k from that of k - 1; the first has weight 1."""
        step = (marked - k + 1).cast("double") * (drawn - k + 1) / (k * (total - marked - drawn + k).cast("double"))
        return F.when(k == start, F.lit(1.0)).otherwise(w * step)

    def add(state: Column, k: Column) -> Column:
        w = weigh(state["w"], k)
        return F.struct(w.alias("w"), (state["sum"] + w).alias("sum"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"))
    mass = F.aggregate(F.sequence(start, end), zero, add)["sum"]

    def find(state: Column, k: Column) -> Column:
        w = weigh(state["w"], k)
        below = state["sum"] + w <= state["aim"]
        return F.struct(w.alias("w"), (state["sum"] + w).alias("sum"), state["aim"].alias("aim"), F.when(below, F.least(k + 1, end)).otherwise(state["k"]).alias("k"))

    first = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), (mass * u).alias("aim"), start.alias("k"))
    return F.aggregate(F.sequence(start, end), first, find)["k"]


def permuted(x: Column, n: Column, key: Column, seed: int = _SEED) -> Column:
    """The place of x in a pseudorandom permutation of 0 to n - 1 that ``key`` names, by a swap-or-not shuffle.

    Each round pairs x with k - x modulo n for a k of its own, and swaps a pair or not by a hash of its larger member.
    """

    def swap(at: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), key, i), n) - at, n)
        return F.when(F.pmod(F.xxhash64(F.lit(seed), key, i, F.greatest(at, other)), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def splitting_tree(blocks: DataFrame, levels: int, seed: int = _SEED) -> DataFrame:
    """``blocks(rank, n)`` -> ``(shard, rank, quota)``: the blocks of each source for each of 2^levels shards."""
    root = blocks.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("n").cast("long").alias("n")))).alias("all"))
    nodes = root.where(F.size("all") > 0).select(F.lit(1).cast("long").alias("node"), F.col("all.rank").alias("ranks"), F.col("all.n").alias("counts"))
    for _ in range(levels):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)

        def draw(state: Column, i: Column) -> Column:
            n = F.element_at("counts", i)
            u = F.pmod(F.xxhash64(F.lit(seed), F.col("node"), i), F.lit(1 << 52)) / float(1 << 52)
            got = hypergeometric(state["left"], n, state["need"], u)
            return F.struct((state["left"] - n).alias("left"), (state["need"] - got).alias("need"), F.array_append(state["out"], got).alias("out"))

        start = F.struct(F.col("total").alias("left"), F.floor(F.col("total") / 2).alias("need"), F.array().cast("array<long>").alias("out"))
        drawn = nodes.withColumn("total", total).withColumn("one", F.aggregate(F.sequence(F.lit(1), F.size("counts")), start, draw)["out"])
        halves = F.posexplode(F.array("one", F.zip_with("counts", "one", lambda a, b: a - b))).alias("side", "counts")
        nodes = drawn.select("node", "ranks", halves).select((F.col("node") * 2 + F.col("side")).alias("node"), "ranks", "counts")
    leaves = nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.inline(F.arrays_zip("ranks", "counts")))
    return leaves.select("shard", F.col("ranks").alias("rank"), F.col("counts").alias("quota"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", levels: int = SHARD_LEVELS, block_words: int = BLOCK_WORDS, key_col: str | None = None) -> DataFrame:
    """``(id, size, source_size, target, draws)`` for every input row.

    draws lists the row's copies in the mix as structs (shard, place): the output shard, and the key by which the
    shard orders its rows. Texts without words are never drawn; null texts have size 0; null sources form one source;
    ids may be null or repeated, and texts then tell rows apart; ``key_col``, if any, comes back as id. Other columns are ignored, whatever their names. Runs on equal input agree.
    """
    rows = df.select(F.col(key_col or id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(_SEED), id_col, text_col).alias("h"))
    rows = materialise(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sources = source_targets(sizes.select("source", "source_size")).join(sizes.select(F.col("source").alias("s"), "n_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(MAX_REPEATS), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.when(F.col("whole") < MAX_REPEATS, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0)))
    sources = materialise(sources.withColumn("buckets", F.ceil(F.col("n_rows") / BUCKET_ROWS)), "sources")

    known = sources.select(F.col("source").alias("s"), "rank", "source_size", "rest", "buckets")
    placed = rows.join(broadcast_if_small(known, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    is_large = F.col("size") * LARGE_SHARE > F.col("source_size")

    # Large documents: fewer than LARGE_SHARE of a source, folded in order of falling size class.
    order = F.struct((-F.floor(F.log2("size"))).alias("c"), "h", "id", "size")
    part = F.col("rest") / F.col("source_size")

    def take(state: Column, x: Column) -> Column:
        due = (state["before"] + x["size"]) * state["part"] - state["taken"] >= x["size"] / 2
        one = F.struct(x["id"].alias("id"), x["size"].alias("size"), x["h"].alias("h"), state["before"].alias("before"), due.alias("extra"))
        return F.struct((state["before"] + x["size"]).alias("before"), (state["taken"] + F.when(due, x["size"]).otherwise(F.lit(0))).alias("taken"), state["part"].alias("part"), F.array_append(state["out"], one).alias("out"))

    kind = rows.schema["id"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("taken"), F.col("part"), F.array().cast(f"array<struct<id:{kind},size:bigint,h:bigint,before:bigint,extra:boolean>>").alias("out"))
    large = placed.where(is_large).groupBy("rank").agg(F.max(part).alias("part"), F.array_sort(F.collect_list(order)).alias("docs"))
    large = materialise(large.select("rank", F.aggregate("docs", start, take).alias("r")).select("rank", "r.before", "r.taken", "r.out"), "large")

    # Small documents: prefix sums over hash buckets.
    small = placed.where(~is_large).select("id", "size", "h", "rank", F.pmod("h", "buckets").alias("bucket"))
    sums = small.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("bucket_before"))
    within = Window.partitionBy("rank", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    small = small.join(sums, ["rank", "bucket"]).withColumn("before", F.col("bucket_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))

    # Blocks, their shards, and the permutation by which shards draw them.
    at_large = large.select("rank", F.col("before").alias("large_words"), F.col("taken").alias("large_taken"))
    plan = sources.join(at_large, "rank", "left").fillna(0, ["large_words", "large_taken"]).withColumn("small_due", F.greatest(F.col("rest") - F.col("large_taken"), F.lit(0.0)))
    tape = F.col("whole") * F.col("source_size") + F.when(F.col("rest") > 0, F.col("large_words") + F.col("small_due")).otherwise(F.lit(0.0))
    plan = materialise(plan.withColumn("n", F.ceil(tape / block_words)), "plan")
    quotas = splitting_tree(plan.select("rank", "n"), levels)
    upto = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    quotas = quotas.withColumn("upto", F.sum("quota").over(upto)).groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("ranges"))
    plan = plan.select("rank", "source_size", "target", "whole", "n", "large_words", "small_due").join(quotas, "rank", "left")

    taken = large.select("rank", F.inline("out")).select("rank", "id", "size", "h", "before", "extra", F.lit(False).alias("small"))
    taken = taken.unionByName(small.select("rank", "id", "size", "h", "before", F.lit(False).alias("extra"), F.lit(True).alias("small")))
    taken = taken.join(broadcast_if_small(plan, BROADCAST_SOURCES), "rank")
    extra = F.when(F.col("small"), F.col("before") + F.col("size") / 2 <= F.col("small_due")).otherwise(F.col("extra"))
    copies = F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(F.lit(0))
    spot = F.col("before") + F.when(F.col("small"), F.col("large_words")).otherwise(F.lit(0))

    def place(epoch: Column) -> Column:
        block = F.least(F.floor((epoch * F.col("source_size") + spot) / block_words), F.col("n") - 1)
        # The lambdas bind the turn and the shard, which would else be worked out again at each mention.
        turn = permuted(block, F.col("n"), F.col("rank"))
        shard = F.transform(F.array(turn), lambda t: F.size(F.filter("ranges", lambda x: x <= t)))
        return F.get(F.transform(shard, lambda s: F.struct(s.alias("shard"), F.xxhash64(F.lit(_SEED), s, F.col("h"), epoch).alias("place"))), 0)

    draws = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), place)).otherwise(F.array().cast("array<struct<shard:int,place:bigint>>"))
    return taken.withColumn("copies", copies.cast("int")).select("id", "size", "source_size", "target", draws.alias("draws"))


def mixed_shards(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy, ``(shard, id, place)``, dealt by shard and salt and shuffled locally."""
    rows = mixed.select(F.inline("draws"), "id").select("shard", "id", "place")
    return rows.repartition("shard", F.pmod("place", F.lit(64))).sortWithinPartitions("shard", "place")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows of ``docs`` with all their columns, each as often as it is drawn, in their shards' order.

    Ids may repeat or be null, as rows are told apart by :func:`row_keyed`. Null and wordless texts are never drawn; a
    null source is a source of its own; very long texts are counted whole; an empty table gives an empty one.
    """
    row, shard, place = (unused(docs, x) for x in ("_row", "_shard", "_place"))
    keyed = row_keyed(docs, id_col, text_col, row)
    drawn = mix(keyed, id_col, text_col, source_col, key_col=row)
    copies = drawn.select(F.col("id").alias(row), F.inline("draws")).select(row, F.col("shard").alias(shard), F.col("place").alias(place))
    rows = keyed.join(copies, row).repartition(shard, F.pmod(place, F.lit(64))).sortWithinPartitions(shard, place)
    return rows.select(*docs.columns)
