"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

A 64-bit fingerprint splits into segments A (23 bits), B (23 bits) and C (18 bits). The perfect (23, 12, 7) Golay
code decodes any 23-bit word to exactly one codeword within 3 errors. A segment's fuzzy keys are the codeword
indices that the word itself and its 23 one-bit neighbours decode to (one key, or six): two words within 2 errors
have a neighbour in common and so share a key. With at most 4 errors in all, pigeonholing them over the segments
leaves these cases, each with a family of bucket keys that the two fingerprints must share:

* at most 2 errors in A and in B: a pair (fuzzy A, fuzzy B), 24 bits;
* 3 or 4 in A: B is exact and C holds at most one error (key: exact B), or C is exact and B holds one (C, fuzzy B);
* 3 or 4 in B: likewise exact A, or (C, fuzzy A).

Buckets hold distinct fingerprints only, are sorted by key and streamed; each candidate is verified by popcount, and
a bucket yields a spanning forest of its links rather than all of its pairs, which leaves components unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise, row_keyed, ship, type_of, unused
from heddle.llm.components import components

RADIUS = 4
#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0xC75
#: Runs of a key up to this long are compared by shifted arrays, longer ones by a search that joins components.
SHORT_RUN = 32


def majority(digests: np.ndarray) -> int:
    """The SimHash of shingle hashes: the bits that over half of them have; of none: zero."""
    raw = np.ascontiguousarray(digests, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 4096):
        ones += np.unpackbits(raw[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a text's word shingles as unsigned 64 bits; no words: zero."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        digests = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digests = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(digests, np.uint64))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint's bits as a signed long."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(lambda b: _fingerprint_batches(b, shingle, seed), f"id {type_of(df, id_col)}, fp long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 23 single bits, and the error pattern of each of the 2048 syndromes."""
    bits = []
    for k in range(23):
        v = 1 << k
        for p in range(22, 10, -1):
            if v >> p & 1:
                v ^= GENERATOR << (p - 11)
        bits.append(v)
    errors = np.zeros(2048, np.int64)
    for a in range(23):
        errors[bits[a]] = 1 << a
        for b in range(a):
            errors[bits[a] ^ bits[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[bits[a] ^ bits[b] ^ bits[c]] = 1 << a | 1 << b | 1 << c
    return np.array(bits, np.int64), errors


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word its sorted distinct codeword indices, six columns, unused ones -1."""
    bits, errors = _golay()
    syndrome = np.zeros(len(words), np.int64)
    for k in range(23):
        syndrome ^= np.where(words >> k & 1, bits[k], 0)
    index = np.empty((len(words), 24), np.int64)
    index[:, 0] = (words ^ errors[syndrome]) >> 11
    for k in range(23):
        index[:, k + 1] = (words ^ 1 << k ^ errors[syndrome ^ bits[k]]) >> 11
    index.sort(axis=1)
    new = np.ones_like(index, bool)
    new[:, 1:] = index[:, 1:] != index[:, :-1]
    rank = new.cumsum(axis=1) - 1
    out = np.full((len(words), 6), -1, np.int64)
    at = np.nonzero(new)
    out[at[0], rank[at]] = index[at]
    return out


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key) for every bucket that a fingerprint enters."""
    u = fps.view(np.uint64)
    a, b, c = ((u >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((0, 2**23 - 1), (23, 2**23 - 1), (46, 2**18 - 1)))
    fa, fb, n = fuzzy_keys(a), fuzzy_keys(b), len(fps)
    who, keys = [np.arange(n)] * 2, [1 << 40 | a, 2 << 40 | b]
    for family, fuzzy in ((3, fa), (4, fb)):
        row, col = np.nonzero(fuzzy >= 0)
        who.append(row)
        keys.append(family << 40 | c[row] << 12 | fuzzy[row, col])
    pair = np.where((fa[:, :, None] >= 0) & (fb[:, None, :] >= 0), fa[:, :, None] << 12 | fb[:, None, :], -1).reshape(n, 36)
    row, col = np.nonzero(pair >= 0)
    return np.concatenate([*who, row]), np.concatenate([*keys, pair[row, col]])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 4096):
            part = np.ascontiguousarray(fps[at : at + 4096])
            who, keys = bucket_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[who])], names=["key", "fp"])


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph of fingerprints within ``radius``."""
    left, heads, tails, frontier = fps, [], [], []
    while len(left):
        if not frontier:
            frontier, left = [left[0]], left[1:]
        head = frontier.pop()
        near = np.bitwise_count(left ^ head) <= radius
        if near.any():
            got = left[near]
            left = left[~near]
            heads.append(np.full(len(got), head))
            tails.append(got)
            frontier.extend(got)
    none = np.empty(0, np.uint64)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (none, none)


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys: all of a short run, a spanning forest of a long one."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[first, len(keys)])
    short = np.repeat(length <= SHORT_RUN, length)
    heads, tails = [], []
    for step in range(1, min(SHORT_RUN, int(length.max(initial=0)))):
        i = np.flatnonzero(short[:-step] & (keys[:-step] == keys[step:]))
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= radius]
        heads.append(fps[i])
        tails.append(fps[i + step])
    for k in np.flatnonzero(length > SHORT_RUN):
        h, t = _forest(np.unique(fps[first[k] : first[k] + length[k]]), radius)
        heads.append(h)
        tails.append(t)
    none = np.empty(0, np.uint64)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (none, none)


def _link_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key; a run that a batch cuts waits for the next one."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def linked(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads, tails = bucket_links(k, f, radius)
        if len(heads):
            pairs = np.unique(np.stack([np.minimum(heads, tails), np.maximum(heads, tails)], 1), axis=0).view(np.int64)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["u", "v"])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        waiting.append((k, f))
        if k[0] == k[-1] and waiting[0][0][0] == k[0]:
            continue  # all of one run so far
        keys, fps = (np.concatenate([x[j] for x in waiting]) for j in (0, 1))
        cut = np.searchsorted(keys, keys[-1])
        yield from linked(keys[:cut], fps[:cut])
        waiting = [(keys[cut:], fps[cut:])]
    if waiting:
        yield from linked(*(np.concatenate([x[j] for x in waiting]) for j in (0, 1)))


def fingerprint_links(distinct_fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``distinct_fps(fp)`` -> links ``(u, v)`` whose components are those of all pairs within ``radius`` <= 4."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the bucket keys hold for 0 to {RADIUS} errors")
    keys = distinct_fps.select("fp").mapInArrow(_key_batches, "key long, fp long")
    runs = keys.repartition("key").sortWithinPartitions("key")
    return runs.mapInArrow(lambda b: _link_batches(b, radius), "u long, v long")


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 4) -> DataFrame:
    """One row ``(id, fp, component)`` for each input row; component is the smallest id reachable by links.

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows come back as often as they
    came in. Ids that are null get the smallest id of their component, null when it holds none. Other columns are
    ignored, whatever their names. An empty table gives an empty one.
    """
    rows = materialise(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = materialise(components(fingerprint_links(classes, radius)), "roots")
    least = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = least.groupBy("root").agg(F.min("least").alias("component"))
    named = least.join(linked, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups_of: Callable[..., DataFrame] = near_duplicate_groups) -> DataFrame:
    """One row of each component with all its columns, the one with the smallest id; rows without an id stay too.

    Rows are told apart by id, text and their number among rows that agree in both, so ids may repeat: rows of one id
    with different texts stay unless their texts are near copies. Null and wordless texts are equal. Texts
    count whole, however long. Any other columns come through, and an empty table gives an empty one.
    """
    row = unused(docs, "_row")
    keyed = row_keyed(docs, id_col, text_col, row)
    groups = groups_of(keyed.select(row, text_col), row, text_col)
    gone = materialise(groups.where("id <> component and not id.none").select(F.col("id").alias(row)), "groups")
    return keyed.join(gone, row, "left_anti").select(docs.columns)
