"""Toxicity: minority languages, slices, repeated rows and ids, and the memory of a reused worker."""

import random

import numpy as np
import pytest

from heddle.llm import toxicity as tx
from heddle.llm.common import byte_slices, worker_memory


def corpus(n, seed):
    """Two languages, the smaller one with marks of its own that few toxic documents have."""
    rng = random.Random(seed)
    for i in range(n):
        small, toxic = rng.random() < 0.1, rng.random() < 0.3
        letters = "bdgkvz" if small else "aeioulnrst"
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 150))]
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), "mjolka" + rng.choice(["", "st", "en"]) if small else rng.choice(["grumpf", "vlorgh"]))
        yield " ".join(words).encode(), int(toxic), small


@pytest.fixture(scope="module")
def model():
    rows = list(corpus(900, 1))
    return tx.fit([t for t, *_ in rows], [y for _, y, _ in rows])


def test_marks_of_a_small_language_count(model):
    fresh = list(corpus(500, 2))
    scores, _ = tx.score_texts(model, [t for t, *_ in fresh])
    for small in (False, True):
        right = [(s >= 0.5) == y for s, (_, y, z) in zip(scores, fresh, strict=True) if z == small]
        assert np.mean(right) >= 0.97


def test_a_passage_in_a_long_text_counts(model):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(4000)]
    clean, toxic = " ".join(words), " ".join([*words[:3000], *["grumpf", "vlorgh"] * 6, *words[3000:]])
    scores, offending = tx.score_texts(model, [clean.encode(), toxic.encode()])
    assert scores[0] < 0.5 <= scores[1] and set(offending[1]) >= set(range(3000, 3012))


def test_pieces_change_nothing(model, monkeypatch):
    texts = [t for t, *_ in corpus(40, 4)] + [None, b"", b" \n", b"x" * 5000, b" ".join(t for t, *_ in corpus(60, 5))]
    whole = tx.score_texts(model, texts)
    monkeypatch.setattr(tx, "SLICE_BYTES", 300)
    monkeypatch.setattr(tx, "SLICE_TOKENS", 70)
    pieces = tx.score_texts(model, texts)
    assert np.allclose(whole[0], pieces[0], atol=1e-8) and whole[1] == pieces[1]


def test_slices_hold_all_rows():
    assert list(byte_slices(np.array([3, 4, 9, 0, 1, 1]), 5)) == [(0, 1), (1, 2), (2, 3), (3, 6)]
    assert list(byte_slices(np.array([], np.int64), 5)) == []


def test_another_model_finds_no_stale_weights(model):
    text = [b"grumpf vlorgh grumpf vlorgh grumpf"]
    before = tx.score_texts(model, text)[0][0]
    other = tx.Model({}, -2.0, model.trans, model.start, model.layer, "other")
    assert tx.score_texts(other, text)[0][0] < before == tx.score_texts(model, text)[0][0]
    assert worker_memory("someone else") == {} and tx.score_texts(model, text)[0][0] == before


def test_repeated_ids_and_rows(spark):
    rows = [(i, t.decode()) for i, (t, *_) in enumerate(corpus(200, 6))]
    toxic = {i: y for i, (_, y, _) in enumerate(corpus(200, 6))}
    docs = spark.createDataFrame([*rows, *rows[:50], (7, "another text of id seven")], "doc_id long, text string")
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    model = tx.train(docs, labels)
    assert tx.train(docs.repartition(5), labels).digest == model.digest
    got = tx.toxicity(docs, model).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {i: 1 + (i < 50) + (i == 7) for i in range(200)}


def test_clashing_columns_and_nulls_in_any(spark, model):
    docs = spark.createDataFrame([(None, None, 1.0, [1]), (1, "grumpf vlorgh grumpf vlorgh grumpf grumpf", None, None), (1, "a b", 2.0, [])], "doc_id long, text string, score double, offending array<int>")
    assert tx.toxicity(docs, model).count() == 3
    kept = tx.without_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(str(r["text"]) for r in kept.collect()) == ["None", "a b"]


def test_labels_without_texts_take_no_places(spark):
    rows = list(corpus(300, 11))
    docs = spark.createDataFrame([(i, t.decode()) for i, (t, *_) in enumerate(rows)] + [(400, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y, _) in enumerate(rows)], "doc_id long, toxic int")
    others = spark.range(1000, 41_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    model = tx.train(docs, labels.unionByName(others), sample_rows=200)
    scores = {r["id"]: r["score"] for r in tx.toxicity(docs, model).collect()}
    assert np.mean([(scores[i] >= 0.5) == y for i, (_, y, _) in enumerate(rows)]) > 0.9


def test_fit_lets_go_of_other_operators_memory():
    from heddle.llm import common
    from heddle.llm import toxicity as tx

    common.worker_memory("token output")["words"] = bytearray(1000)
    assert list(tx._part_batches(iter([]), None)) == [] and "token output" not in common._worker_memory
