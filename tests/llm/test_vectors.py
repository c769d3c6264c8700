"""Clustering and vector codes against plain Python written from the rules."""

import hashlib
import math
import random

import numpy as np
import pytest

from heddle.llm import clustering as cl
from heddle.llm import vector_codes as vc
from heddle.llm.vectors import widest


def usable(v, dims=None):
    return v is not None and (dims is None or len(v) == dims) and all(x is not None and math.isfinite(x) for x in v)


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_clusters(rows, dims, scale, k, rounds, salt=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if usable(v, dims)]
    by = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in by[:k]]
    nearest = lambda v: min((squared(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            centres[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return centres, [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept]


def plain_codes(rows, parts, entries, rounds, scale, dims):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if usable(v, dims)]
    width = dims // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    nearest = lambda v, p: min((squared(cut(v, p), c), n) for n, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(nearest(v, p)[1], []).append(cut(v, p))
            books[p] = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(books[p])]
    return books, [(i, label, "".join(f"{nearest(v, p)[1]:02x}" for p in range(parts)), sum(nearest(v, p)[0] for p in range(parts))) for i, label, v in kept]


def odd_rows(n, dims, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "a", "b"]), [round(rng.gauss(i % 5, 0.4), 2) for _ in range(dims)]) for i in range(n)]
    rows += [rows[3]] * 40 + [(7, "a", [0.5] * dims), (7, "b", [-0.5] * dims), (None, "a", [1.0] * dims), (None, None, [1.0] * dims)]
    bad = [None, [], [1.0], [math.nan] + [0.0] * (dims - 1), [math.inf] + [0.0] * (dims - 1), [None] + [0.0] * (dims - 1), [0.0] * (dims + 1)]
    return rows + [(1000 + i, "a", v) for i, v in enumerate(bad)]


def frame(spark, rows):
    """The rows over several partitions, with a column of every name that the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(5)
    return df.withColumns({c: F.lit(1) for c in ("id", "v", "code", "salt", "cluster", "distance", "name")})


@pytest.mark.parametrize("seed", range(4))
def test_partial_distances_find_the_nearest(seed):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-3, 4, (500, 20)), rng.integers(-3, 4, (11, 20))
    c[5] = c[2]  # a tie everywhere
    near, distance, terms = cl.nearest(x, c, rng.permutation(20), step=3)
    full = np.square(x[:, None] - c[None]).sum(2)
    assert (near == full.argmin(1)).all() and (distance == full.min(1)).all() and terms < full.size * 20


def test_clusters_as_rules_say(spark):
    rows = odd_rows(120, 12)
    found = cl.cluster(frame(spark, rows), dims=12, k=6)
    centres, want = plain_clusters([(i, v) for i, _, v in rows], 12, 64, 6, 3)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = cl.cluster_rows(found).collect()
    assert found.centroids.tolist() == centres and sorted([(r["id"], r["cluster"], r["distance"]) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert r["inertia"] == sum(w[2] for w in want) and r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_empty_clusters_stay_and_few_vectors_do(spark):
    rows = [(i, "a", [0.0, 0.0]) for i in range(30)] + [(99, "a", [5.0, 5.0])]
    found = cl.cluster(frame(spark, rows), dims=2, k=4)
    assert found.centroids.tolist() == plain_clusters([(i, v) for i, _, v in rows], 2, 64, 4, 3)[0] and len(found.centroids) == 4
    assert cl.cluster(frame(spark, rows[:3]), dims=2, k=16).rows.count() == 3
    for none in (rows[:0], [(1, "a", None)]):
        assert cl.cluster_rows(cl.cluster(frame(spark, none), dims=2)).collect() == []


def test_codes_as_rules_say(spark):
    rows = odd_rows(150, 12)
    found = vc.compress(frame(spark, rows), parts=4, entries=20)
    books, want = plain_codes(rows, 4, 20, 2, 256, 12)
    got = vc.code_rows(found).collect()
    assert found.codebooks.tolist() == books
    whole = [r for r in got if r["code"] is not None]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", *r[2:])
    assert sorted([(r["id"], r["label"], r["code"], r["error"]) for r in whole], key=key) == sorted(want, key=key)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    assert all(r["label_error"] == sum(w[3] for w in want if w[1] == r["label"]) and r["codebooks_sha256"] == digest for r in whole)
    # Vectors of other lengths have no codes, and no error to add.
    assert sorted(r["id"] for r in got if r["code"] is None) == [1001, 1002, 1006]


def test_many_labels_are_joined_by_salted_keys(spark, monkeypatch):
    rows = odd_rows(60, 4)
    found = vc.compress(frame(spark, rows), parts=2, entries=8)
    few = sorted(map(str, vc.code_rows(found).collect()))
    monkeypatch.setattr(vc, "FEW_LABELS", 1)
    assert sorted(map(str, vc.code_rows(found).collect())) == few


def test_codes_of_empty_tables(spark):
    for none in ([], [(1, "a", None)], [(1, "a", [0.0] * 3)]):
        found = vc.code_rows(vc.compress(frame(spark, none), parts=4))
        assert [(r["id"], r["code"]) for r in found.collect()] == [(i, None) for i, _, v in none if v]


def test_tree_merges_partitions_without_blocks():
    books = np.zeros((2, 1, 1), np.int64)
    one = vc.add_block(None, np.array([[1, 2], [3, 4]], "<i8").tobytes(), books)
    assert vc.merge_sums(None, one) is one and vc.merge_sums(None, None) is None
    total, count = vc.merge_sums(one, one)
    assert total.reshape(-1).tolist() == [6, 14] and count.tolist() == [[4], [4]]


def test_components_without_an_exact_distance_raise(spark):
    rows = [(1, "a", [float(widest(2)), 0.0]), (2, "a", [0.0, 0.0])]
    with pytest.raises(Exception, match="no exact squared distance"):
        cl.cluster(frame(spark, rows), dims=2, k=2).rows.collect()
