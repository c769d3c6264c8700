"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact shingle similarity.

Every benchmark item of L words is compared with every window of L words of every document (a shorter document is
one window). Words are lower-cased, stripped of what is not alphanumeric at their ends, and hashed; shingles are five
words (the whole sequence where an item has fewer). The weight of a shingle is how often it occurs; the similarity of
two bags is the sum of least weights over the sum of greatest.

1. A window can only reach the threshold if enough of its shingles occur in some item; a running count finds the
   windows that can. This bound loses nothing and leaves nearly all of a clean text out.
2. The remaining windows get a 64-bit SimHash. It is cut into eight bytes; if two fingerprints differ in at most
   RADIUS bits, some byte differs in at most RADIUS // 8, so a table of the items near each byte value
   lists, for each of the eight bytes, all that can be within the radius. Listed pairs within the radius are candidates.
3. Candidates are verified by exact weighted similarity.

At the threshold of 0.8 two fingerprints differ in 9.7 bits on average with a deviation of 2.9, so a radius of 22
misses a best window with probability below 1e-5, and less for closer ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import ship, type_of

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 22
#: Items go to the executors in blocks of at most so many characters; every block meets all documents.
BLOCK_CHARS = 4_000_000
#: Distinct words that a Python worker remembers.
CACHE_WORDS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)

_words: dict[bytes, int] = {}


def _strip(word: str) -> str:
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower()


def _hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; zero for a word without letters or digits."""
    try:
        return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        from xxhash import xxh64_intdigest

        if len(_words) > CACHE_WORDS:
            _words.clear()
        for w in set(words).difference(_words):
            _words[w] = xxh64_intdigest(s) or 1 if (s := _strip(w.decode())) else 0
        return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def word_hashes(text: bytes | None) -> np.ndarray:
    """The hashes of a UTF-8 text's white-space-separated words."""
    return _hash_words((text or b"").split())


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words (of all words where there are fewer)."""
    k = max(1, min(k, len(words)))
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ words[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def window_simhashes(hashes: np.ndarray, starts: np.ndarray, wide: int) -> np.ndarray:
    """SimHash of hashes[a : a + wide] for each a of the sorted starts; a bit is 1 where over half have it."""
    at, end = int(starts[0]), int(starts[-1]) + wide
    bits = np.unpackbits(np.ascontiguousarray(hashes[at:end]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros((end - at + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=ones[1:])
    return np.packbits(2 * (ones[starts - at + wide] - ones[starts - at]) > wide, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / (a.total() + b.total() - shared) if a or b else 0.0


class Items:
    """The benchmark's items grouped by their number of words, with the tables that find candidates."""

    def __init__(self, items: list[tuple[object, str | None]], shingle: int, least: float, radius: int):
        self.k, self.least, self.radius = shingle, least, radius
        kept = []
        for key, text in items:
            w = word_hashes((text or "").encode())
            if len(w := w[w != 0]):
                kept.append((key, len(w), shingles(w, shingle)))
        self.keys = [key for key, _, _ in kept]
        self.bags = [Counter(s.tolist()) for *_, s in kept]
        self.prints = np.array([window_simhashes(s, np.array([0]), len(s))[0] for *_, s in kept], np.uint64)
        lengths = np.array([n for _, n, _ in kept], np.int64)
        self.by_length = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
        #: For each size of shingle in use, the sorted hashes of all items, and a bit table that most others miss.
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in {min(shingle, n) for n in self.by_length}:
            every = np.unique(np.concatenate([s for _, n, s in kept if min(shingle, n) == k]))
            table = np.zeros(1 << 22, bool)
            table[(every >> np.uint64(42)).astype(np.int64)] = True
            self.known[k] = every, table
        self.owners: dict[int, set[int]] = {}
        for i, (_, _, s) in enumerate(kept):
            for x in s.tolist():
                self.owners.setdefault(x, set()).add(i)
        #: near[n][byte][value]: which items of n words have a byte there within radius // 8 bits of the value.
        distance = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
        self.near = {n: [(distance <= radius // 8)[:, (self.prints[i] >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)] for b in range(8)] for n, i in self.by_length.items()}

    def _hits(self, s: np.ndarray, k: int) -> np.ndarray:
        every, table = self.known[k]
        hit = table[(s >> np.uint64(42)).astype(np.int64)]
        if hit.any():
            at = np.flatnonzero(hit)
            pos = np.minimum(np.searchsorted(every, s[at]), len(every) - 1)
            hit[at] = every[pos] == s[at]
        return hit

    def possible(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray]]:
        """Of many texts, the position and word hashes of those that share any shingle with any item."""
        split = [(t or b"").split() for t in texts]
        raw = _hash_words([w for words in split for w in words])
        ends = np.cumsum([len(words) for words in split])
        full = np.flatnonzero(raw)
        words = raw[full]
        owner = np.searchsorted(ends, full, "right")
        found: set[int] = set()
        for k in self.known:
            if len(words) >= k:
                hit = np.flatnonzero(self._hits(shingles(words, k), k))
                found.update(owner[hit[owner[hit] == owner[hit + k - 1]]].tolist())
        for i in sorted(found):
            yield i, raw[ends[i] - len(split[i]) : ends[i]]

    def matches(self, text: bytes | None) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, last word + 1) of the best window for each item found; leftmost of equals."""
        return self.best_windows(word_hashes(text))

    def best_windows(self, raw: np.ndarray) -> list[tuple[int, float, int, int]]:
        """The same from a text's word hashes."""
        place = np.flatnonzero(raw)
        words = raw[place]
        if not len(words):
            return []
        hits = {}
        for k in self.known:
            s = shingles(words, k) if len(words) >= k else np.empty(0, np.uint64)
            hit = self._hits(s, k)
            hits[k] = (s, np.r_[0, np.cumsum(hit)]) if hit.any() else None
        out = []
        sharing = set().union(*(self.owners[x] for found in hits.values() if found for x in np.unique(found[0][np.diff(found[1]) > 0]).tolist()))
        for n, group in self.by_length.items():
            k, group = min(self.k, n), np.array([i for i in group.tolist() if i in sharing], np.int64)
            if not len(group) or not hits[k]:
                continue
            s, count = hits[k]
            wide = min(n, len(words)) - k + 1
            inside = count[wide:] - count[:-wide]
            starts = np.flatnonzero(inside >= self.least * (n - k + 1))
            for part in np.split(starts, np.flatnonzero((np.diff(starts) > 256) | (np.diff(starts // 4096) > 0)) + 1):
                if len(part):
                    out += self._verified(s, part, wide, n, group)
        best: dict[int, tuple[float, int, int]] = {}
        for item, sim, a, b in out:
            if item not in best or (sim, -a) > (best[item][0], -best[item][1]):
                best[item] = (sim, a, b)
        return [(item, sim, int(place[a]), int(place[b - 1]) + 1) for item, (sim, a, b) in best.items()]

    def _verified(self, s: np.ndarray, starts: np.ndarray, wide: int, n: int, group: np.ndarray) -> list[tuple[int, float, int, int]]:
        prints = window_simhashes(s, starts, wide)
        listed = np.zeros((len(starts), len(group)), bool)
        for b in range(8):
            listed |= self.near[n][b][:, np.searchsorted(self.by_length[n], group)][(prints >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)]
        w, g = np.nonzero(listed)
        close = np.bitwise_count(prints[w] ^ self.prints[group[g]]) <= self.radius
        out = []
        for a, item in zip(starts[w[close]].tolist(), group[g[close]].tolist(), strict=True):
            sim = similarity(Counter(s[a : a + wide].tolist()), self.bags[item])
            if sim >= self.least:
                out.append((item, sim, a, a + wide + min(self.k, n) - 1))
        return out


def _match_batches(batches: Iterator[pa.RecordBatch], items, id_type: pa.DataType, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    found = items.value if hasattr(items, "value") else items
    for batch in batches:
        ids, keys, sims, first, last = [], [], [], [], []
        for at in range(0, batch.num_rows, 256):
            for row, raw in found.possible(batch.column(1).slice(at, 256).to_pylist()):
                for item, sim, a, b in found.best_windows(raw):
                    ids.append(at + row)
                    keys.append(found.keys[item])
                    sims.append(sim)
                    first.append(a)
                    last.append(b)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(keys, key_type), pa.array(sims, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["id", "item", "similarity", "first_word", "end_word"])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of bounded size, streamed to the driver partition by partition."""
    block, chars = [], 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        chars += len(row[1] or "")
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """``(id, item, similarity, first_word, end_word)`` for each document and item whose best window reaches ``least``.

    Offsets count the document's white-space-separated words. Null, empty and wordless texts and items match nothing.
    Repeated documents and items give a row each. Other columns are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type, key_type = to_arrow_type(docs.schema[id_col].dataType), to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"id {type_of(docs, id_col)}, item {type_of(benchmark, item_col)}, similarity double, first_word long, end_word long"
    parts = []
    for block in _blocks(benchmark, item_col, item_text_col):
        items = spark.sparkContext.broadcast(Items(block, shingle, least, radius))
        parts.append(rows.mapInArrow(lambda b, items=items: _match_batches(b, items, id_type, key_type), schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _clean_batches(batches: Iterator[pa.RecordBatch], shared, text_at: int) -> Iterator[pa.RecordBatch]:
    items = shared.value
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            clean = np.ones(part.num_rows, bool)
            for row, raw in items.possible(part.column(text_at).cast(pa.binary()).to_pylist()):
                clean[row] = not items.best_windows(raw)
            yield part.filter(pa.array(clean))


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """The rows that match no item, with all their columns, without a shuffle; each block of items filters in turn."""
    spark, out, text_at = docs.sparkSession, docs, docs.columns.index(text_col)
    ship(spark)
    for block in _blocks(benchmark, item_col, item_text_col):
        items = spark.sparkContext.broadcast(Items(block, shingle, least, radius))
        out = out.mapInArrow(lambda b, items=items: _clean_batches(b, items, text_at), docs.schema)
    return out
