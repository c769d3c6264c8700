"""The conditional random field, and the embedding index against brute force."""

import random
import zlib

import numpy as np

from heddle.llm import embedding_dedup as ed
from heddle.llm import toxicity as tx


def plain_marginals(e, trans, start):
    m, n = np.exp(trans), len(e)
    emit = np.stack([np.ones(n), np.exp(e)], 1)
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    a[0] = emit[0] * [1, np.exp(start)]
    for t in range(1, n):
        a[t] = emit[t] * (a[t - 1] / a[t - 1].sum() @ m)
    for t in range(n - 2, -1, -1):
        b[t] = m @ (emit[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    p = a * b
    return (p / p.sum(1, keepdims=True))[:, 1]


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    lengths = np.array([0, 3, 700, 1, 0, 3000, 257, 256, 0])
    e, trans = rng.normal(-1, 3, lengths.sum()), rng.normal(0, 1, (2, 2))
    got, at = tx.marginals(e, lengths, trans, 0.3)[0], 0
    for n in lengths:
        if n:
            assert np.allclose(got[at : at + n], plain_marginals(e[at : at + n], trans, 0.3), atol=1e-12)
        at += n


def made_up(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    for i in range(n):
        toxic = rng.random() < 0.3
        words = [word() for _ in range(rng.randint(5, 120))]
        if toxic:
            for _ in range(rng.randint(2, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vlorgh!", "grumpf", "grumpfes", "grumpfin,", "zzyx"]))
        yield i, " ".join(words), int(toxic)


def test_held_out_accuracy(spark):
    rows = list(made_up(900, 1)) + [(1000, None, 0), (1001, "", 0), (1002, "x " * 40000, None), (None, "grumpf grumpf", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").selectExpr("*", "1 as score", "2 as id")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 1 - rows[3][2])], "doc_id long, toxic int")
    model = tx.train(docs, labels.where("doc_id <> 3"))
    got = {r["id"]: r for r in tx.toxicity(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(i, t, y) for i, t, y in rows[:900] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i]["score"] >= 0.5) == y for i, _, y in held]) > 0.97
    for i, t, y in held:
        if y and got[i]["offending"]:
            assert tx.core(t.split()[got[i]["offending"][0]].encode()).startswith(("vlo", "gru", "zzy"))
    assert got[1000]["score"] == got[1001]["score"] < 0.5
    clean = {r["doc_id"] for r in tx.without_toxic(docs, model).collect()}
    assert clean == {i for i, r in got.items() if r["score"] < 0.5}
    assert tx.toxicity(docs.limit(0), model).count() == 0


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        assert {r["score"] < 0.5 for r in tx.toxicity(docs, tx.train(docs, some)).collect()} == {True}


def test_training_never_sees_held_out_rows(spark):
    rows = [(i, f"w{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tx.train(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert not [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0 and f"w=w{i}" in model.weights]


def test_embedding_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = [(centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 1.0])).tolist() for _ in range(500)]
    rows = [(i, v, int(rng.integers(3))) for i, v in enumerate(x)]
    rows += [(500 + k, x[7], rows[7][2]) for k in range(30)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None] * 16, 1), (604, x[7], None), (605, [float("inf")] + [1.0] * 15, 1), (606, [], 1), (607, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as key", "2 as list", "3 as v")
    got = {r["id"]: (r["n_links"], r["component"], r["kept"]) for r in ed.embedding_groups(df, deviations=4).collect()}
    v = np.array([np.array(r[1], np.float32) for r in rows[:530]], np.float64)
    v /= np.sqrt((v**2).sum(1))[:, None]
    labels = np.array([r[2] for r in rows[:530]])
    linked = (v @ v.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    root = np.arange(530)
    for _ in range(530):
        new = np.minimum(root, np.where(linked, root[None, :], 10**6).min(axis=1))
        if (new == root).all():
            break
        root = new
    for i in range(530):
        assert got[i] == (linked[i].sum(), root[i], root[i] == i)
    for i in range(600, 608):
        assert got[i] == (0, i, True)
    assert ed.embedding_groups(df.limit(0)).count() == 0
    some = {r["id"]: r["n_links"] for r in ed.embedding_groups(df).collect()}
    assert all(some[i] <= got[i][0] for i in some) and sum(some.values()) >= 0.98 * sum(n for n, _, _ in got.values())


def test_search_loses_nothing():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.1])
    x /= np.sqrt((x**2).sum(1))[:, None]
    index = ed.fit_index(x[::2], len(x))
    coarse, codes, left = ed.encode(index, x)
    reach = (2 - 2 * 0.93) ** 0.5
    who, lists = ed.probes(index, x, reach)
    found = set()
    for c in range(len(index.centroids)):
        db, q = np.flatnonzero(coarse == c), who[lists == c]
        i, k = ed.search(index, c, x[db], codes[db], left[db], x[q], 0.93)
        found |= set(zip(q[i].tolist(), db[k].tolist(), strict=True))
    assert found == set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.93)), strict=True))


def test_pairs_of_lists_are_met_from_one_side():
    """Of two lists only the later one asks, and what both sides of all lists would find is found whole."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 12))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.1])
    x /= np.sqrt((x**2).sum(1))[:, None]
    index = ed.fit_index(x[::2], len(x))
    coarse, codes, left = ed.encode(index, x)
    order = np.argsort(coarse, kind="stable")
    x, coarse, codes, left = x[order], coarse[order], codes[order], left[order]
    reach = (2 - 2 * 0.93) ** 0.5
    who, lists = ed.probes(index, x, reach, coarse)
    assert (lists <= coarse[who]).all() and len(who) < 0.7 * len(ed.probes(index, x, reach)[0])
    i, k = ed.search_lists(index, ed.coded(index, x, coarse, codes, left), x, coarse, 0.93, reach)
    got = list(zip(i.tolist(), k.tolist(), strict=True))
    a, b = np.nonzero(x @ x.T >= 0.93)
    assert len(got) == len(set(got)) and set(got) == {(p, q) for p, q in zip(a.tolist(), b.tolist(), strict=True) if coarse[q] <= coarse[p]}
