"""Packing against exact searches on small cases, and the contract on odd documents."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heddle.llm import packing as pk
from heddle.llm.token_output import WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """The least number of sequences, by trying every placement with pruning."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def place(i, fill):
        nonlocal best
        if len(fill) >= best:
            return
        if i == len(lengths):
            best = len(fill)
            return
        for room in sorted(set(fill)):
            if room + lengths[i] <= capacity:
                at = fill.index(room)
                place(i + 1, [*fill[:at], room + lengths[i], *fill[at + 1 :]])
        place(i + 1, [*fill, lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_bounds_never_exceed_the_fewest(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 16, 30])
    low = rng.choice([1, 1, capacity // 4, capacity // 3, capacity // 2])
    lengths = [rng.randint(max(1, low), capacity) for _ in range(rng.randint(1, 9))]
    bound, best = pk.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity), fewest(lengths, capacity)
    _, _, fill = pk.best_fit_decreasing(np.array(lengths), capacity)
    assert bound <= best <= len(fill) and fill.max() <= capacity and fill.sum() == sum(lengths)


def test_bounds_beyond_the_sum_of_lengths():
    of = lambda lengths: pk.lower_bound(np.bincount(lengths, minlength=101), 100)
    assert of([51] * 7) == 7 and of([34] * 9) == 5 and of([60, 60, 41, 41]) == 3 and of([26] * 8) == 3 and of([]) == 0 and of([100] * 3) == 3


def test_best_fit_takes_the_tightest_room():
    sequence, offset, fill = pk.best_fit_decreasing(np.array([3, 6, 4, 7]), 10)
    assert sequence.tolist() == [0, 1, 1, 0] and offset.tolist() == [7, 0, 6, 0] and fill.tolist() == [10, 10]


def documents(spark, texts):
    """Every fifth document has no id, and ids repeat; a column of every name that the operator uses inside."""
    rows = [(None if i % 5 == 4 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    return df.withColumns({c: F.lit(1) for c in ("id", "piece", "part", "serial", "sequence", "offset", "length", "free")}), rows


def held(rows, capacity):
    """Checks that sequences are gapless and hold no more than they may; returns their number."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def odd_texts(n, seed=4):
    rng = random.Random(seed)
    return [None, "", " \n", "long " * 9000, "x" * 70000] + ["same words again"] * 400 + [" ".join(rng.choice(["alpha", "beta", "Γάμμα", "delta-9", "…"]) for _ in range(int(rng.expovariate(1 / 60)))) for _ in range(n)]


def test_every_piece_has_its_place(spark):
    df, rows = documents(spark, odd_texts(1200))
    capacity = 512
    found = pk.pack(df, WORDS, capacity=capacity, group=200)
    got, encode = found.rows.collect(), Tokenizer.from_file(WORDS)
    want = []
    for i, text in rows:
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, p, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity])) for p, a in enumerate(range(0, len(ids), capacity))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    n, total = held(got, capacity), sum(w[3] for w in want)
    assert -(-total // capacity) <= found.bound <= n <= found.bound * 1.01 + 1 and n == found.rounds[-1][2]
    assert all(b[2] <= a[2] for a, b in itertools.pairwise(found.rounds)) and found.rounds[0][0] > 1


def test_exchange_closes_gaps_that_partitions_leave(spark):
    rng = random.Random(8)
    df, _ = documents(spark, [" ".join(["word"] * rng.randint(20, 60)) for _ in range(900)])
    alone = pk.pack(df, WORDS, capacity=128, group=60, exchanges=0)
    found = pk.pack(df, WORDS, capacity=128, group=60)
    assert held(alone.rows.collect(), 128) == alone.rounds[-1][2] and found.bound <= held(found.rows.collect(), 128) < alone.rounds[-1][2]


def test_certified_partitions_stop_at_once(spark):
    df, _ = documents(spark, [" ".join(["word"] * 70) for _ in range(50)])
    found = pk.pack(df, WORDS, capacity=128, group=1000)
    assert found.rounds == [(1, 1, 50)] and found.bound == 50


def test_empty_tables(spark):
    df, _ = documents(spark, ["a"])
    found = pk.pack(df.limit(0), WORDS)
    assert found.rows.collect() == [] and found.bound == 0


def test_long_words_are_not_kept():
    encode = WordEncoder(WORDS)
    for k in range(0, 40_000, 400):
        encode([" ".join(f"{i:x}" * 40 for i in range(k + 10**6, k + 10**6 + 400)).encode()])
    assert encode.flat.nbytes < 100 << 20 and len(encode.slots) <= 2
