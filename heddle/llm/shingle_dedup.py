"""Near-duplicates by SimHash, and by the Jaccard similarity of word shingles for what it misses, exactly.

SimHash comes first: texts whose fingerprints differ in RADIUS bits or fewer, found by op8's fuzzy keys, are compared, and
those that reach the similarity are linked. At a similarity of 0.8 some ten bits differ, so that many similar pairs are
farther apart than any search by fingerprints can reach; the rest of this module finds these, and looks only at pairs
that the links so far don't join already.

Two sets of n shingles or more that reach a similarity of t share at least ceil(t n) of them. So, in any one order of
all shingles, the first n - ceil(t n) + 1 of each set (its prefix) hold a common shingle: prefixes are keys that cover
every pair. The order is by hash, shingles that a sample finds repeated last, so that prefixes hold rare ones; whatever
the sample says, the order is the same for all sets and no pair is lost.

Equal sets are one class. Within the classes of a key, after SimHash, each is first verified against one of them, the one whose keys most
others have: the text that the others are copies of, if it is there. Then only pairs across components remain. They are
never rows: the classes of a key go to a unit, named by the component that most of them have, and a unit's pairs are
compared in blocks, those outside its component against all. A block's task verifies pairs by their sets, nearest
first, and yields the links that join components, fewer than it has classes; what is joined is not compared again. So
a group of near copies costs rows for its classes, not for its pairs.

Before sets are fetched, a bound thins the pairs: of two sets' bitmaps, in which each shingle flips one bit, no more bits
differ than the sets differ in shingles. It passes every pair that is similar enough. Bitmaps of 256 bits travel with the
keys, and of a key only classes with another one that they leave go to its unit; bitmaps as long as the sets thin units.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import give_back, materialise, ship, type_of, worker_memory
from heddle.llm.components import components
from heddle.llm.simhash_dedup import RADIUS, fingerprint_links, majority

SHINGLE, SIMILARITY = 5, 0.8
#: Documents in which repeated shingles are looked for, and most of these.
SAMPLE, COMMON = 20_000, 200_000
#: Longer runs of a key go to their unit whole, to be thinned in blocks.
LONG_RUN = 4096
#: Classes, and shingles of these, on either side of a block of a unit's pairs, about.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Bits of the bitmaps that thin a block's pairs before their sets are compared, and pairs compared at once.
WIDE, AT_ONCE = 4096, 32
_SKETCH = ("s0", "s1", "s2", "s3")
_NUMBERS = ", ".join(f"{c} long" for c in _SKETCH)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles in lower case; a shorter text is one shingle, no words none."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([xxh64_intdigest(joined[a:b]) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64))


def least_shared(n: int, similarity: float) -> int:
    return math.ceil(similarity * n - 1e-9)


def prefix(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of which two similar sets share one: rare ones first."""
    if not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
    known = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
    ordered = np.concatenate([hashes[~known], hashes[known]])
    return ordered[: len(hashes) - least_shared(len(hashes), similarity) + 1]


def bitmap(hashes: np.ndarray) -> bytes:
    """As many bits as shingles, up to the next power of two and eight at least; each shingle flips the bit that its low bits name."""
    bits = 1 << max(3, (max(len(hashes), 1) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """At most the number of shingles that only one of two sets has; the longer bitmap is folded."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def sketch(hashes: np.ndarray, bits: int = 256) -> np.ndarray:
    """The bitmap of so many bits, whatever the number of shingles, as numbers of 64 bits."""
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1, bitorder="little").view(np.int64)


def most_apart(m: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles sets of these sizes may differ in at most if they are similar."""
    return (1 - similarity) / (1 + similarity) * (m + n) + 1e-6


def _class(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes())).view(np.int64))


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    worker_memory("near copies")
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            yield piece, piece.column(column).to_pylist()


def _sample_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for _, texts in _texts(batches, 0):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, size) for t in texts]).view(np.int64))], names=["key"])


def _prefix_batches(batches: Iterator[pa.RecordBatch], shared, size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    common = shared.value
    for piece, texts in _texts(batches, 1):
        sets = [shingles(t, size) for t in texts]
        keys = [prefix(s, common, similarity).tobytes() for s in sets]
        words = np.array([sketch(s) for s in sets], np.int64).reshape(len(sets), 4)
        prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(list(map(_class, sets)), pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary()), pa.array(list(map(bitmap, sets)), pa.binary()), pa.array(prints), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(4))], names=["id", "class", "n", "prefix", "bits", "fp", *_SKETCH])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            piece = batch.slice(at, 1024)
            keys = [np.frombuffer(x, np.int64) for x in piece.column("prefix").to_pylist()]
            who = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(piece.column(c).take(who) for c in ("class", "n", *_SKETCH))], names=["key", "class", "n", *_SKETCH])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first one, cut between its values only."""
    waiting: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        waiting.append(columns)
        if columns[0][-1] == waiting[0][0][0]:
            continue  # all of one run so far
        columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
        cut = np.searchsorted(columns[0], columns[0][-1])
        yield [x[:cut] for x in columns]
        waiting = [[x[cut:] for x in columns]]
    if waiting:
        yield [np.concatenate(x) for x in zip(*waiting, strict=True)]


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key another class has."""
    for columns in _runs(batches):
        same = columns[0][1:] == columns[0][:-1]
        kept = np.r_[False, same] | np.r_[same, False]
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in columns], names=["key", "class", "n", *_SKETCH])


def _unit_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Classes that share a key with one of another component, but for those whose sizes or sketches are too far from all such; unit is the key's most frequent component."""

    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        all_of = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(all_of[:, k])) for k in range(3)), pa.array(all_of[:, 3].astype(np.int32))], names=["unit", "class", "root", "n"])

    found, held = [], 0
    for keys, classes, sizes, root, *words in _runs(batches):
        words = np.stack(words, 1).view(np.uint64)  # bits of negative numbers are counted as those of their absolute value
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[first[1:], len(keys)]
        mixed = np.logical_or.reduceat(root != np.repeat(root[first], ends - first), first)
        for a, b in zip(first[mixed].tolist(), ends[mixed].tolist(), strict=True):
            names, member, count = np.unique(root[a:b], return_inverse=True, return_counts=True)
            c, n, largest = classes[a:b], sizes[a:b], count.argmax()
            kept = np.full(b - a, b - a > LONG_RUN)
            # The largest component's rows are met from the others' side only.
            for i in np.flatnonzero((member != largest) & ~kept):
                at = np.flatnonzero((member != member[i]) & (np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i]) - 1e-9) & ((member == largest) | (c > c[i])))
                at = at[np.bitwise_count(words[a:b][at] ^ words[a + i]).sum(1) <= most_apart(n[at], n[i], similarity)]
                kept[at] = True
                kept[i] |= len(at) > 0
            if kept.any():
                found.append(np.stack([np.full(kept.sum(), names[largest]), c[kept], root[a:b][kept], n[kept].astype(np.int64)], 1))
                held += len(found[-1])
            if held > 1 << 18:
                yield rows(found)
                found, held = [], 0
    if found:
        yield rows(found)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, one table for each of its values."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        at = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if waiting and waiting[0].column(0)[0].as_py() != at[a]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _thin_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of a block, the classes that bitmaps leave another one from another component."""
    worker_memory("near copies")
    for block in _blocks(batches):
        n, root, one, other = (block.column(c).to_numpy() for c in ("n", "root", "one", "other"))
        bits = [np.frombuffer(x, np.uint8) for x in block.column("bits").to_pylist()]
        length = np.array(list(map(len, bits)))
        rows = {size: np.flatnonzero(length == size) for size in np.unique(length).tolist()}
        maps = {size: np.stack([bits[k] for k in at]) for size, at in rows.items()}
        kept = np.zeros(len(n), bool)
        for i in np.flatnonzero(one):
            for size in {length[i] // 2, length[i], length[i] * 2} & maps.keys():  # of sizes farther apart none is similar
                close = (root[rows[size]] != root[i]) & other[rows[size]] & (np.minimum(n[rows[size]], n[i]) >= similarity * np.maximum(n[rows[size]], n[i]) - 1e-9)
                at, theirs, mine = rows[size][close], maps[size][close], bits[i]
                if size > length[i]:
                    theirs = theirs[:, : length[i]] ^ theirs[:, length[i] :]
                elif size < length[i]:
                    mine = mine[:size] ^ mine[size:]
                at = at[np.bitwise_count(theirs ^ mine).sum(1, dtype=np.int64) <= most_apart(n[at], n[i], similarity)]
                kept[at] = True
                kept[i] |= len(at) > 0
        if kept.any():
            yield from block.select(["unit", "class", "root", "n"]).filter(pa.array(kept)).combine_chunks().to_batches()


def joining(classes: np.ndarray, root: np.ndarray, sets: list[np.ndarray], one: np.ndarray, other: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links between similar sets, one of ``one`` and one of ``other``, that join the components ``root`` as all such links would."""
    n, root, heads, tails = np.array(list(map(len, sets))), root.copy(), [], []
    words = np.stack([sketch(s, WIDE) for s in sets]).view(np.uint64)
    for i in np.flatnonzero(one):
        at = np.flatnonzero(other & (root != root[i]) & (np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i]) - 1e-9))
        apart = np.bitwise_count(words[at] ^ words[i]).sum(1, dtype=np.int64)
        near = apart <= most_apart(n[at], n[i], similarity)
        at = at[near][np.argsort(apart[near], kind="stable")]
        while len(at := at[root[at] != root[i]]):
            some, at = at[:AT_ONCE], at[AT_ONCE:]
            theirs = np.concatenate([sets[k] for k in some])
            shared = sets[i][np.minimum(np.searchsorted(sets[i], theirs), n[i] - 1)] == theirs
            both = np.add.reduceat(shared, np.cumsum(n[some]) - n[some], dtype=np.int64)
            for k in some[both >= similarity * (n[some] + n[i] - both) - 1e-9]:
                if root[k] != root[i]:
                    heads.append(int(min(classes[k], classes[i])))
                    tails.append(int(max(classes[k], classes[i])))
                    root[root == root[k]] = root[i]
    return heads, tails


def _joining_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    worker_memory("near copies")
    for block in _blocks(batches):
        sets = [np.frombuffer(x, np.uint64) for x in block.column("set").to_pylist()]
        heads, tails = joining(*(block.column(c).to_numpy() for c in ("class", "root")), sets, *(block.column(c).to_numpy() for c in ("one", "other")), similarity)
        if heads:
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array(tails, pa.int64())], names=["u", "v"])


def in_blocks(units: DataFrame) -> DataFrame:
    """``units(unit, class, root, n)`` -> these rows for each block that they enter.

    A block holds classes from outside the unit's component (``one``) and any of its classes (``other``). Each of the former meets each
    class of the unit in one block. Both sides hold about BLOCK classes or BLOCK_SHINGLES shingles at most.
    """
    outside = F.col("root") != F.col("unit")

    def parts(rows: Column) -> Column:
        return F.greatest(F.ceil(F.sum(rows.cast("long")) / BLOCK), F.ceil(F.sum(F.when(rows, F.col("n").cast("long"))) / BLOCK_SHINGLES)).cast("int")

    sizes = units.groupBy("unit").agg(parts(outside).alias("p"), parts(F.lit(True)).alias("q")).where("p > 0")
    mine, yours = F.pmod(F.xxhash64("class"), "p").cast("int"), F.pmod(F.xxhash64("class"), "q").cast("int")

    def entry(i: Column, j: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), (outside & (i == mine)).alias("one"), (j == yours).alias("other"))

    across = F.when(outside, F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: entry(mine, j))).otherwise(F.array().cast("array<struct<i:int,j:int,one:boolean,other:boolean>>"))
    down = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: entry(i, yours))
    rows = units.join(sizes, "unit").withColumn("b", F.explode(F.array_union(across, down)))
    return rows.select(F.xxhash64("unit", "b.i", "b.j").alias("block"), "unit", "class", "root", "n", "b.one", "b.other")


def _set_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for _, texts in _texts(batches, 0):
        sets = [shingles(t, size) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(list(map(_class, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "set"])


def _near_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v, m, n = (batch.column(k).to_pylist() for k in ("u_bits", "v_bits", "u_n", "v_n"))
        keep = [bits_apart(a, b) <= most_apart(x, y, similarity) for a, b, x, y in zip(u, v, m, n, strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _similar_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(k).to_pylist() for k in (2, 3))
        keep = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def simhash_pairs(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``classes(class, fp)`` -> pairs ``(u, v)`` whose components are those of all classes with fingerprints within ``radius``."""
    least = materialise(classes.groupBy("fp").agg(F.min("class").alias("least")), "fingerprints")
    u, v = (least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_class")) for x in ("u", "v"))
    near = fingerprint_links(least, radius).distinct().join(v, "v").join(u, "u").select(F.col("u_class").alias("u"), F.col("v_class").alias("v"))
    same = classes.join(least, "fp").where("class <> least").select(F.col("class").alias("u"), F.col("least").alias("v"))
    return near.unionByName(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, sample: int = SAMPLE) -> DataFrame:
    """One row ``(id, component)`` for each input row; component is the smallest id reachable by similar texts.

    Null and wordless texts are equal. Repeated rows come back as often as they came in. Ids that are null get the
    smallest id of their component, null when it holds none. Other columns are ignored. An empty table gives an empty one.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    share = min(1.0, sample / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) <= share * (1 << 40)).select("text").distinct()
    often = drawn.mapInArrow(lambda b: _sample_batches(b, size), "key long").groupBy("key").count().where("count > 1")
    common = often.orderBy(F.desc("count"), "key").limit(COMMON).select("key").toArrow()["key"].to_numpy()
    shared = spark.sparkContext.broadcast(np.sort(common.view(np.uint64)))
    give_back()

    rows = docs.mapInArrow(lambda b: _prefix_batches(b, shared, size, similarity), f"id {type_of(df, id_col)}, class long, n int, prefix binary, bits binary, fp long, {_NUMBERS}")
    rows = materialise(rows, "prefixes")
    classes = rows.groupBy("class").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("fp").alias("fp"), *(F.first(c).alias(c) for c in _SKETCH))
    classes = materialise(classes, "classes")
    keys = classes.select("class", "n", "prefix", *_SKETCH).mapInArrow(_key_batches, f"key long, class long, n int, {_NUMBERS}")
    runs = keys.repartition("key").sortWithinPartitions("key")
    met = materialise(runs.mapInArrow(_shared_batches, f"key long, class long, n int, {_NUMBERS}"), "shared")

    def sets_of(wanted: DataFrame) -> DataFrame:
        least = wanted.join(classes.select("class", "least"), "class").where("least is not null").select(F.col("least").alias("id")).distinct()
        # Of rows with equal ids, and of those without, the class that the text gives names the right one.
        texts = docs.join(least, "id", "left_semi").unionByName(docs.where("id is null")).select("text")
        sets = texts.mapInArrow(lambda b: _set_batches(b, size), "class long, set binary").join(wanted, "class", "left_semi")
        return materialise(sets.groupBy("class").agg(F.first("set").alias("set")), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        u, v = (classes.select(F.col("class").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits")) for x in ("u", "v"))
        pairs = pairs.distinct().join(v, "v").join(u, "u").mapInArrow(lambda b: _near_batches(b, similarity), "u long, v long")
        pairs = materialise(pairs, "candidates")
        sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct())
        u, v = (sets.select(F.col("class").alias(x), F.col("set").alias(f"{x}_set")) for x in ("u", "v"))
        both = pairs.join(v, "v").join(u, "u").select("u", "v", "u_set", "v_set")
        return materialise(both.mapInArrow(lambda b: _similar_batches(b, similarity), "u long, v long"), "similar")

    def sorted_blocks(units: DataFrame, more: DataFrame) -> DataFrame:
        return in_blocks(units).join(more, "class").repartition("block").sortWithinPartitions("block").select("block", "unit", "class", "root", "n", "one", "other", *more.columns[1:])

    links = verified(simhash_pairs(classes.select("class", "fp")))
    roots = materialise(components(links), "roots").withColumnRenamed("node", "class")
    # A class's reach: how many other classes its keys have. That of a text of which others are copies is largest.
    sizes = met.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("others"))
    reach = met.join(sizes, "key").groupBy("class").agg(F.sum("others").alias("reach"))
    heads = met.join(reach, "class").groupBy("key").agg(F.max(F.struct("reach", "class", "n")).alias("head"))
    heads = materialise(heads.select("key", F.col("head.class").alias("u"), F.col("head.n").alias("m")), "heads")
    close = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9
    stars = met.select("key", "class", "n").join(heads, "key").where((F.col("u") != F.col("class")) & close)
    # What is joined already needs no more links.
    of_head = roots.select(F.col("class").alias("u"), F.col("root").alias("head_root"))
    stars = stars.join(roots, "class", "left").join(of_head, "u", "left").where(F.coalesce("root", "class") != F.coalesce("head_root", "u"))
    links = links.unionByName(verified(stars.select(F.least("u", "class").alias("u"), F.greatest("u", "class").alias("v"))))
    roots = materialise(components(links), "roots").withColumnRenamed("node", "class")

    held = met.join(roots, "class", "left").select("key", "class", "n", F.coalesce("root", "class").alias("root"), *_SKETCH)
    unit = "unit long, class long, root long, n int"
    units = held.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _unit_batches(b, similarity), unit)
    units = materialise(units.distinct(), "units")
    units = sorted_blocks(units, classes.select("class", "bits")).mapInArrow(lambda b: _thin_batches(b, similarity), unit)
    units = materialise(units.distinct(), "units")
    joined = sorted_blocks(units, sets_of(units.select("class").distinct())).mapInArrow(lambda b: _joining_batches(b, similarity), "u long, v long")
    links = links.unionByName(materialise(joined.distinct(), "similar"))
    roots = materialise(components(links), "roots").withColumnRenamed("node", "class")

    named = classes.select("class", "least").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return rows.select("id", "class").join(named.join(least, "root").select("class", "component"), "class").select("id", "component")
