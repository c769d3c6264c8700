"""Embedding links at production defaults, in as many dimensions as the table has, against brute force."""

import numpy as np

from heddle.llm import embedding_dedup as ed


def test_defaults_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.sqrt((v**2).sum(1))[:, None]
    centres = unit(rng.normal(size=(40, 64)))
    tight = unit(np.repeat(centres, 30, 0) + rng.normal(0, 0.01, (1200, 64)))
    # Pairs on either side of the border between two centres, their offset along the line between these.
    a, b = (centres[rng.permutation(40)[np.arange(200) % 40]] for _ in range(2))
    step = 0.18 * unit(a - b + 1e-9)
    middle = unit(a + b) * np.sqrt(1 - 0.18**2)
    v = np.concatenate([tight, middle + step, middle - step]).astype(np.float32)
    x = unit(v.astype(np.float64))
    near = (x @ x.T >= ed.COSINE) & ~np.eye(len(v), dtype=bool)
    equal = (v[:, None, :] == v[None]).all(2) & ~np.eye(len(v), dtype=bool)
    rows = spark.createDataFrame([(i, y.tolist(), 1) for i, y in enumerate(v)], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(ed, "LIST_CHUNK", 100)
    monkeypatch.setattr(ed, "QUERY_CHUNK", 90)
    got = {r["id"]: r["n_links"] for r in ed.embedding_groups(rows).collect()}
    assert got == dict(enumerate((near | equal).sum(1).tolist()))
